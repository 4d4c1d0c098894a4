"""Follow-up SQL text for a query family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylens.functions.text import quote_like, quote_literal

# The texts a user pastes into psql.
STATEMENTS_BY_ID = (
    "select queryid, calls, total_exec_time, mean_exec_time, rows, query "
    "from pg_stat_statements where queryid = ",
    ";",
)
STATEMENTS_BY_TEXT = (
    "select queryid, calls, total_exec_time, mean_exec_time, rows, query "
    "from pg_stat_statements where query ilike '%",
    "%' order by total_exec_time desc limit 20;",
)
ACTIVITY = (
    "select pid, usename, datname, application_name, state, wait_event_type, "
    "wait_event, query_start, query from pg_stat_activity where ",
    " order by query_start desc nulls last limit 20;",
)
NOT_IDLE = "state <> 'idle'"


def next_sql(
    normalized_sql: Column,
    queryid: Column,
    database: Column,
    user: Column,
    application_name: Column,
) -> Column:
    """Array of two statements: by statement statistics, by current activity."""

    def wrap(ends: tuple[str, str], body: Column) -> Column:
        return F.concat(F.lit(ends[0]), body, F.lit(ends[1]))

    def is_value(column: str, value: Column) -> Column:
        return F.concat(F.lit(f"{column} = '"), quote_literal(value), F.lit("'"))

    # concat_ws skips the filters of absent fields.
    filters = F.concat_ws(
        " and ",
        is_value("datname", database),
        is_value("usename", user),
        is_value("application_name", application_name),
    )
    return F.array(
        F.when(queryid.isNotNull(), wrap(STATEMENTS_BY_ID, queryid)).otherwise(
            wrap(STATEMENTS_BY_TEXT, quote_like(normalized_sql))
        ),
        wrap(ACTIVITY, F.when(filters == "", NOT_IDLE).otherwise(filters)),
    )
