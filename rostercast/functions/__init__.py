"""Column expressions: calendar, holidays, rates, roster policy, scalar attachment."""
