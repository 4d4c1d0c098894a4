"""Logs that several tests read."""

SAMPLE_LOG = """\
2025-03-02 07:15:30.000 UTC [411] shop@store web: LOG:  statement: SELECT title, price FROM books WHERE isbn = '978-3';
2025-03-02 07:15:30.020 UTC [411] shop@store web: LOG:  duration: 20.000 ms
2025-03-02 07:15:31.000 UTC [412] shop@store web: LOG:  statement: SELECT title, price FROM books WHERE isbn = '978-0';
2025-03-02 07:15:31.024 UTC [412] shop@store web: LOG:  duration: 24.000 ms
2025-03-02 07:15:32.000 UTC [413] shop@store jobs: LOG:  statement: UPDATE carts SET touched = CLOCK() WHERE cart_id = 7;
2025-03-02 07:15:32.009 UTC [413] shop@store jobs: LOG:  duration: 9.000 ms
2025-03-02 07:15:33.000 UTC [414] etl@analytics loader: LOG:  statement: SELECT max(day) FROM visits WHERE day >= '2025-01-01';
2025-03-02 07:15:33.018 UTC [414] etl@analytics loader: LOG:  duration: 18.000 ms
2025-03-02 07:15:34.000 UTC [415] shop@store web: ERROR:  column "colour" does not exist
"""
RDS_LOG = """\
2025-03-02 07:20:00 UTC:10.8.0.4(41000):shop@store:[511]:LOG:  statement: SELECT stock FROM shelves WHERE shelf = 12;
2025-03-02 07:20:00 UTC:10.8.0.4(41000):shop@store:[511]:LOG:  duration: 44.000 ms
2025-03-02 07:20:01 UTC:10.8.0.4(41000):shop@store:[511]:LOG:  execute fetch_3: SELECT stock FROM shelves WHERE shelf = $1
2025-03-02 07:20:01 UTC:10.8.0.4(41000):shop@store:[511]:LOG:  duration: 25.000 ms
2025-03-02 07:20:02 UTC:10.8.0.9(41010):etl@analytics:[512]:LOG:  duration: 120.000 ms  statement: SELECT sum(amount) FROM sales WHERE day > '2025-02-01';
"""
BASELINE_LOG = """\
2025-03-01 06:00:00.000 UTC [21] shop@store web: LOG:  statement: SELECT title FROM books WHERE shelf = 1;
2025-03-01 06:00:00.020 UTC [21] shop@store web: LOG:  duration: 20.000 ms
2025-03-01 06:00:01.000 UTC [22] shop@store web: LOG:  statement: SELECT title FROM books WHERE shelf = 2;
2025-03-01 06:00:01.030 UTC [22] shop@store web: LOG:  duration: 30.000 ms
"""
TARGET_LOG = """\
2025-03-02 06:00:00.000 UTC [31] shop@store web: LOG:  statement: SELECT title FROM books WHERE shelf = 3;
2025-03-02 06:00:00.100 UTC [31] shop@store web: LOG:  duration: 100.000 ms
2025-03-02 06:00:01.000 UTC [32] shop@store web: LOG:  statement: SELECT title FROM books WHERE shelf = 4;
2025-03-02 06:00:01.150 UTC [32] shop@store web: LOG:  duration: 150.000 ms
2025-03-02 06:00:02.000 UTC [33] shop@store web: LOG:  statement: DELETE FROM baskets WHERE basket = 1;
2025-03-02 06:00:02.200 UTC [33] shop@store web: LOG:  duration: 200.000 ms
"""
