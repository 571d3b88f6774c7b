"""Interleaved documents: ordered text and media references, payloads by digest.

A page's HTML becomes a sequence of items, each a text or a media reference, in page
order.  References carry the digest of their payload (`src="sha256:..."` or
`data-sha256`), and the caption of their figure or else their alternative text.  The
payloads live in a table keyed by digest; a join on the digest brings its columns to
the references, whatever they are: the stored bytes, or what was read from them where
they lie.  Positions number the items of a page and survive every step, so text,
references and captions stay aligned.

Payloads are stored losslessly as 8-bit grey samples, 64 to a row, in the portable
graymap format, and read back from those bytes.

Cases: null and empty pages have no items; a reference without a digest, or with one
that the table lacks, stays with null payload columns; a digest that comes twice in
the table resolves once; a payload of any length is padded with bytes 0 to a positive
multiple of 64; repeated rows give repeated items; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialize, text_of

ITEM = "struct<pos:int,kind:string,text:string,src:string,digest:string,caption:string>"
WIDTH = 64
_BLOCKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 br hr tr td th table article section blockquote pre figure header footer main dl dt dd".split())
_SILENT = frozenset("script style title head nav noscript template".split())
_MEDIA = frozenset("img video audio source".split())
_VOID = frozenset("img br hr meta link input source".split())
_DIGEST = re.compile(r"(?:sha256:)?([0-9a-f]{64})$")


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def close_text(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text:
            self.items.append({"kind": "text", "text": text})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self.silent += 1
        if self.silent:
            return
        if tag in _BLOCKS:
            self.close_text()
        if tag == "figure":
            self.figure = [len(self.items)]
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA:
            self.close_text()
            own = dict(attrs)
            src = own.get("src")
            found = _DIGEST.match(own.get("data-sha256") or src or "")
            self.items.append({"kind": "media", "src": src, "digest": found and found[1], "caption": own.get("alt") or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.silent:
            return
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            if self.figure:
                for item in self.items[self.figure[0] :]:
                    if item["kind"] == "media" and text:
                        item["caption"] = text
            elif text:
                self.items.append({"kind": "text", "text": text})
        elif tag == "figure":
            self.close_text()
            self.figure = []
        elif tag in _BLOCKS:
            self.close_text()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The page's items in order."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.close_text()
    blank = dict.fromkeys(("text", "src", "digest", "caption"))
    return [blank | item | {"pos": i} for i, item in enumerate(page.items)]


def sequences(pages: DataFrame, key: str, html: Column) -> DataFrame:
    """key and items, an array of ITEM, for every page."""

    @F.pandas_udf(f"array<{ITEM}>")
    def items(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(parse)

    return pages.select(key, items(F.coalesce(html, F.lit(""))).alias("items"))


def distinct_media(media: DataFrame) -> DataFrame:
    """One row for each digest."""
    return media.groupBy("digest").agg(*[F.first(c).alias(c) for c in media.columns if c != "digest"])


def resolve(sequence: DataFrame, key: str, media: DataFrame, distinct: bool = False) -> DataFrame:
    """One row per item: key, the item's fields, and media's columns but its digest.
    distinct: media has a digest once already."""
    once = (media if distinct else distinct_media(media)).withColumnRenamed("digest", "__digest")
    each = sequence.select(key, F.explode("items").alias("item")).select(key, "item.*")
    return each.join(once, F.col("digest") == F.col("__digest"), "left").drop("__digest")


def gather(resolved: DataFrame, key: str) -> DataFrame:
    """The sequences again, each item with its payload columns, in page order."""
    rest = [c for c in resolved.columns if c not in (key, "pos")]
    return resolved.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("items"))


def padded(text: Column) -> Column:
    """The text's UTF-8 bytes and bytes 0 up to a positive multiple of 64."""
    data = text.cast("binary")
    size = F.octet_length(data)
    more = F.greatest(F.ceil(size / WIDTH), F.lit(1)) * WIDTH - size
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), more.cast("int"))))


def store(payload: bytes) -> bytes:
    """A binary portable graymap whose samples are the payload's bytes."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples(media: bytes) -> np.ndarray:
    """The samples of a stored payload, a row per 64 of them."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", media)
    width, height = int(head[1]), int(head[2])
    return np.frombuffer(media, np.uint8, width * height, head.end()).reshape(height, width)


def feature(grey: np.ndarray) -> str:
    """Mean, deviation, entropy in bits, mean step between neighbours in a row, and
    the shares of four grey levels in per mille."""
    counts = np.bincount(grey.ravel(), minlength=256)
    p = counts[counts > 0] / grey.size
    levels = counts.reshape(4, 64).sum(axis=1) * 1000 // grey.size
    x = np.arange(256)
    mean = float(counts @ x) / grey.size
    deviation = max(0.0, float(counts @ (x * x)) / grey.size - mean * mean) ** 0.5
    step = float(np.abs(np.diff(grey.astype(np.int16), axis=1)).mean())
    return f"mean={mean:.4f};std={deviation:.4f};entropy={abs(float(p @ np.log2(p))):.4f};step={step:.4f};levels=" + "/".join(map(str, levels.tolist()))


def stored(payloads: DataFrame) -> DataFrame:
    """digest and media, the stored form, of rows of digest and payload."""

    @F.pandas_udf("binary")
    def form(batch: pd.Series) -> pd.Series:
        return batch.map(store)

    return payloads.select("digest", form("payload").alias("media"))


def described(media: DataFrame) -> DataFrame:
    """digest, and what is read back from the stored form where it lies."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for form in batch:
                grey = samples(form)
                data = grey.tobytes()
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(form), hashlib.sha256(form).hexdigest(), feature(grey)))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("digest", back("media").alias("d")).select("digest", "d.*")


def text_media(docs: DataFrame) -> DataFrame:
    """Every whole text as a medium of a page of its own: docs' texts become stored
    payloads and pages that refer to them; the pages are parsed and their references
    resolved.  Only digests and descriptions are joined; payloads stay in their tasks."""
    sized = docs.select("doc_id", F.monotonically_increasing_id().alias("__page"), padded(text_of()).alias("payload"), F.octet_length(text_of()).cast("long").alias("n_bytes"))
    digest = F.sha2("payload", 256)
    # written, so that the join has an exchange of its own, which splits at a frequent digest
    media = materialize(distinct_media(described(stored(sized.select(digest.alias("digest"), "payload")))))
    figure = F.concat(
        F.lit('<article><figure><img src="sha256:'), digest, F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure></article>")
    )
    pages = sized.select(F.struct("doc_id", "__page", "n_bytes").alias("page"), figure.alias("html"))
    return resolve(sequences(pages, "page", F.col("html")), "page", media, distinct=True).select(
        "page.doc_id", "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption"
    )
