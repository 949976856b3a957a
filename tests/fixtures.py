"""Small hand-made fixtures (FIXTURES.md §3)."""

import datetime as dt

# Golden: the reference's recorded production run for June 2019 (date, predicted,
# adjusted) — policy floor 31, buffer 1.15, weekly totals 651, 2113, 1053, 690, 529.
JUNE_ROSTER = [
    ("2019-06-01", 286.798852319317, 330.0), ("2019-06-02", 278.8611983412635, 321.0),
    ("2019-06-03", 444.488075757649, 512.0), ("2019-06-04", 293.7058848739208, 338.0),
    ("2019-06-05", 374.19414867480873, 431.0), ("2019-06-06", 280.06683035200916, 323.0),
    ("2019-06-07", 230.7778777180881, 266.0), ("2019-06-08", 128.14694838187378, 148.0),
    ("2019-06-09", 82.03094114810054, 95.0), ("2019-06-10", 229.49053689799953, 264.0),
    ("2019-06-11", 153.73941219471416, 177.0), ("2019-06-12", 153.73941219471416, 177.0),
    ("2019-06-13", 155.12259416848616, 179.0), ("2019-06-14", 154.44959582095737, 178.0),
    ("2019-06-15", 40.22792557543943, 47.0), ("2019-06-16", -0.20711431864799554, 31.0),
    ("2019-06-17", 101.65881950952071, 117.0), ("2019-06-18", 206.29435527940132, 238.0),
    ("2019-06-19", 79.43788609549622, 92.0), ("2019-06-20", 80.37544897028339, 93.0),
    ("2019-06-21", 65.02354430002349, 75.0), ("2019-06-22", 38.2377612899165, 44.0),
    ("2019-06-23", 0.6773408670617537, 31.0), ("2019-06-24", 187.56918124396577, 216.0),
    ("2019-06-25", 46.66101752087633, 54.0), ("2019-06-26", 82.7164470390588, 96.0),
    ("2019-06-27", 60.54493795168881, 70.0), ("2019-06-28", 20.18014528947356, 31.0),
    ("2019-06-29", 5.35913830557845, 31.0), ("2019-06-30", 0.6773408670617537, 31.0),
]
JUNE_WEEKLY = [("2019-06-02", 22, 651), ("2019-06-09", 23, 2113), ("2019-06-16", 24, 1053),
               ("2019-06-23", 25, 690), ("2019-06-30", 26, 529)]


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def days(start: str, n: int) -> list[dt.date]:
    s = d(start)
    return [s + dt.timedelta(days=i) for i in range(n)]
