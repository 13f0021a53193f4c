"""Text blocks of web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements whose text is never read.
SKIPPED = ["script", "style", "noscript", "input", "textarea", "select", "option", "code", "pre", "svg", "canvas"]
# Elements without an end tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]

#: Bytes of an Arrow batch of pages, of blocks that leave Python at once, and of a block's row besides its characters.
BATCH_BYTES, OUT_BYTES, ROW_BYTES = 4 << 20, 1 << 20, 200


class Blocks(HTMLParser):
    """Collects text nodes outside skipped and editable elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.closed_by: list[tuple[str, bool]] = []
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            editable = any(k == "contenteditable" and (v or "true").lower() != "false" for k, v in attrs)
            self.closed_by.append((tag, tag in SKIPPED or editable))

    def handle_endtag(self, tag):
        for k in range(len(self.closed_by) - 1, -1, -1):
            if self.closed_by[k][0] == tag:
                del self.closed_by[k:]
                return

    def handle_data(self, data):
        if not any(skipped for _, skipped in self.closed_by):
            self.found.append(" ".join(data.split()))


def blocks_of(html: str | None, least: int = 20) -> list[str]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    return [t for t in parser.found if len(t) >= least]


def page_blocks(pages: DataFrame, key: str, html: str, least: int = 20) -> DataFrame:
    """(key, block_no, text): text nodes of at least so many characters, in order; a page without any has no row.

    Batches of pages are bounded by bytes where the session has no bound, and blocks leave Python before OUT_BYTES of them have piled up, a page's at least.
    """
    kind = pages.schema[key].dataType.simpleString()
    bounded = "spark.sql.execution.arrow.maxBytesPerBatch"
    if pages.sparkSession.conf.get(bounded, None) is None:
        pages.sparkSession.conf.set(bounded, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            keys, places, texts = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=[key, "block_no", "text"])

        for batch in batches:
            rows, held, of = [], 0, batch.schema.field(0).type
            for k, page in zip(batch.column(0), batch.column(1), strict=True):
                for n, t in enumerate(blocks_of(page.as_py(), least)):
                    rows.append((k.as_py(), n, t))
                    held += ROW_BYTES + len(t)
                if held > OUT_BYTES:
                    yield packed(rows, of)
                    rows, held = [], 0
            yield packed(rows, of)

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, block_no long, text string")
