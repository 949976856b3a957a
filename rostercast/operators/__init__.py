"""DataFrame operators: profiling, exploration, evaluation, forecasting, learners, roster reports."""
