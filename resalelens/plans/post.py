"""Selected items to the export table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from resalelens import settings as S
from resalelens.operators import posting
from resalelens.operators.first import capped


def export(items: DataFrame, choice: str, city: str, cap: int | None = None) -> DataFrame:
    """Posting rows of the chosen items, the first ``cap`` of them if there is a daily cap.
    ``items`` is numbered in ``n``."""
    chosen = posting.selected(items, choice)
    return posting.export_rows(chosen if cap is None else capped(chosen, cap, ["n"]), city, S.MAX_EXPORT_TITLE)


def posted(attempts: DataFrame, cap: int) -> DataFrame:
    """Report over the attempts that count under the daily cap."""
    return posting.outcome_report(posting.within_daily_cap(attempts, cap))
