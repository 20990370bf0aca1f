"""Line dedup by site-relative frequency: lines on too large a share of a host's pages go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.functions.rows import computed
from codecorpus.llm.frames import numbered, place, restored
from codecorpus.llm.host_lines import (
    lines_of,
    shared_lines,
    text_of,
    with_shared_lines,
    without_lines,
)

#: Share of the host's pages above which a line is boilerplate, and the pages it needs at least.
MAX_RATIO = 0.1
MIN_PAGES = 2


def site_line_dedup(
    docs: DataFrame,
    *,
    text: str = "text",
    host: str = "source",
    doc_id: str = "doc_id",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``docs`` with clean_text, n_lines and n_dropped.

    For each host the pages that contain a line (in lower case, with single spaces) are divided by
    all pages of the host; lines above ``max_ratio`` that are on ``min_pages`` pages at least are
    dropped, every occurrence of them.  Blank lines stay.  A null text is empty and has one line,
    which is blank; null is a host of its own; rows of one host with the same id and text are one
    page in the counts, and each gets its result; new columns replace columns of the same name in
    any case, and other columns may have any name; an empty table gives an empty table.
    """
    names = ["clean_text", "n_lines", "n_dropped"]
    source = numbered(docs)
    text, host, doc_id = (f"_in{place(docs, name)}" for name in (text, host, doc_id))
    shared = shared_lines(
        source, min_docs=min_pages, share=max_ratio, text=text, host=host, doc_id=doc_id
    )
    rows = with_shared_lines(source, shared, text=text, host=host)
    rows = computed(rows, n_lines=F.size(lines_of(text_of(text))).cast("long"))
    rows = without_lines(rows, text, "n_dropped")
    return rows.select(*restored(docs, names), *names)
