"""The slow-log search as one operation: filters, a page in a total order, and the number of all hits."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.operators.aggregates import with_total
from logharbor.operators.filters import search_slow_logs
from logharbor.operators.paging import clamp_page, page_of


def search_page(docs: DataFrame, request: Mapping[str, Any]) -> DataFrame:
    """The page (``page``, ``pageSize``) of the documents that meet a request, newest first, with ``total``.

    Documents of one time are ordered by id. The total is a count over the same filters, so a page past
    the end is empty.
    """
    hits = search_slow_logs(docs, request)
    page, size = clamp_page(int(request.get("page") or 1), int(request.get("pageSize") or 0))
    return with_total(page_of(hits, page, size, [F.desc("eventTime"), F.asc("doc_id")]), hits)
