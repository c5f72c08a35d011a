"""Functions to call from SQL: scalars of a draft, a paged history, and the order of a draft as a table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SCALARS = [
    # the slot on the clock: forwards, backwards every other round, or backwards in rounds two and three
    """CREATE OR REPLACE TEMPORARY FUNCTION slot_for_pick(pick BIGINT, teams INT, kind STRING, third_reversed BOOLEAN) RETURNS BIGINT RETURN
       CASE WHEN kind = 'linear' THEN (pick - 1) % teams + 1
            WHEN third_reversed AND ((pick - 1) DIV teams IN (1, 2) OR ((pick - 1) DIV teams > 2 AND (pick - 1) DIV teams % 2 = 0)) THEN teams - (pick - 1) % teams
            WHEN NOT coalesce(third_reversed, false) AND (pick - 1) DIV teams % 2 = 1 THEN teams - (pick - 1) % teams
            ELSE (pick - 1) % teams + 1 END""",
    "CREATE OR REPLACE TEMPORARY FUNCTION pick_label(pick BIGINT, teams INT) RETURNS STRING RETURN concat((pick - 1) DIV teams + 1, '.', lpad((pick - 1) % teams + 1, 2, '0'))",
    """CREATE OR REPLACE TEMPORARY FUNCTION valid_draft(teams INT, rounds INT, slots INT, kind STRING, third_reversed BOOLEAN) RETURNS BOOLEAN RETURN
       teams BETWEEN 4 AND 22 AND teams % 2 = 0 AND rounds = slots AND (NOT third_reversed OR kind = 'snake')""",
    "CREATE OR REPLACE TEMPORARY FUNCTION bid_limit(budget BIGINT, empty_slots INT, least INT) RETURNS BIGINT RETURN CASE WHEN empty_slots > 0 THEN greatest(budget - (empty_slots - 1) * least, 0) ELSE 0 END",
]


@udtf(returnType="pick bigint, round int, pick_in_round int")
class DraftOrder:
    """The picks of a draft in order: ``FROM draft_order(teams, rounds)``; no rows unless both are positive."""

    def eval(self, teams: int, rounds: int) -> Iterator[tuple]:
        for i in range(max(teams or 0, 0) * max(rounds or 0, 0)):
            yield i + 1, i // teams + 1, i % teams + 1


def register(spark: SparkSession, history: str | None = None) -> None:
    """Puts the functions into a session.

    ``history`` names a view ``(owner, at, id)``: ``history_page(owner, size, page)`` then gives a page of an
    owner's rows, the latest first, with their number and the number of all.
    """
    for sql in SCALARS:
        spark.sql(sql)
    spark.udtf.register("draft_order", DraftOrder)
    if history:
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION history_page(who BIGINT, size INT, page INT) RETURNS TABLE (id BIGINT, at TIMESTAMP, row INT, total BIGINT) RETURN
            SELECT id, at, row, total FROM (SELECT id, at, CAST(row_number() OVER (ORDER BY at DESC, id) AS INT) AS row, count(*) OVER () AS total FROM {history} WHERE owner = history_page.who)
            WHERE row > history_page.size * (history_page.page - 1) AND row <= history_page.size * history_page.page""")
