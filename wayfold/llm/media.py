"""Media columns: HTML with media becomes an ordered sequence of text and media structs; digests resolve the payloads.

pages      ->  interleave()  ->  _sequence: array<struct<pos, kind 'text'|'media', text, digest, caption>> in document order
payloads   ->  store()       ->  a written table (digest, stored): content-addressed bytes
its bytes  ->  described()   ->  (digest, measures and features), computed from what is read back
both       ->  resolve()     ->  pages whose media structs hold what their digests resolve to, each at its position beside its caption

A payload is stored as a portable graymap (P5): rows of 24 8-bit samples under a text header; 576 samples make a 24 x 24 tile.

store() writes payloads where they lie, once for each task that meets them, so no payload is shuffled; measures are grouped by digest. References
join them by digest, pages and payloads don't move: what does is a list of digests for each distinct one, and pages meet it by that list. Both joins
are between written tables or plain exchanges, so that adaptive execution can split a digest that a third of all pages share.

Parsing: a caption is the text of a figcaption and belongs to all media of its figure, before or after it; it ends with the figcaption, with the
figure if that isn't closed, and is plain text if neither is closed, or if the figure has no media. An img's alt text is its caption where no other is.
What a template holds is left out, unless it isn't closed; script and style are left out up to their end tag, as browsers do.

Defined results: a null text is the empty text, whose payload is 576 bytes of 255; a null page has an empty sequence; references that no payload
resolves keep a null `media`; text nodes without visible characters are left out, others have white space collapsed; repeated rows are kept and agree;
empty tables give empty ones; interleave() and resolve() replace a column _sequence and keep all others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, let, packed, small_batches, table, tidy

WIDTH, TILE, PAD = 24, 576, 255
SEQUENCE = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
SCHEME = "sha256:"


class _Sequence(HTMLParser):
    """Collects text nodes and img, video and audio references in order."""

    INLINE = frozenset(("b", "i", "em", "strong", "a", "span", "u", "small", "sub", "sup", "code"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.raw = False  # in script or style
        self.templates: list[int] = []  # where open templates began
        self.figure = self.caption = -1  # where the open figure and its open caption began
        self.said: tuple[int, str] | None = None  # place and text of the figure's closed caption

    def flush(self) -> None:
        if words := " ".join("".join(self.text).split()):
            self.out.append({"kind": "text", "text": words, "digest": None, "caption": None})
        self.text = []

    def end_caption(self) -> None:
        self.flush()
        if self.caption >= 0:
            inside, self.out = self.out[self.caption :], self.out[: self.caption]
            self.said = (self.caption, " ".join(x["text"] for x in inside if x["kind"] == "text"))
            self.out += [x for x in inside if x["kind"] == "media"]
            self.caption = -1

    def end_figure(self) -> None:
        self.end_caption()
        if self.figure >= 0 and self.said and self.said[1]:
            media = [x for x in self.out[self.figure :] if x["kind"] == "media"]
            for x in media:
                x["caption"] = self.said[1]
            if not media:
                self.out.insert(self.said[0], {"kind": "text", "text": self.said[1], "digest": None, "caption": None})
        self.figure, self.said = -1, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.raw = True
        elif tag in ("img", "video", "audio"):
            self.flush()
            at = dict(attrs)
            self.out.append({"kind": "media", "text": None, "digest": (at.get("src") or "").removeprefix(SCHEME), "caption": at.get("alt")})
        elif tag == "template":
            self.flush()
            self.templates.append(len(self.out))
        elif tag == "figure":
            self.end_figure()
            self.figure = len(self.out)
        elif tag == "figcaption":
            self.end_caption()
            if self.figure >= 0 and self.said is None:
                self.caption = len(self.out)
        elif tag not in self.INLINE:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.raw = False
        elif tag == "template":
            self.flush()
            if self.templates:
                del self.out[self.templates.pop() :]
                # a figure or caption that began inside of it is gone with it
                self.figure = self.figure if self.figure <= len(self.out) else -1
                self.caption = self.caption if self.caption <= len(self.out) else -1
        elif tag == "figure":
            self.end_figure()
        elif tag == "figcaption":
            self.end_caption()
        elif tag not in self.INLINE:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.raw:
            self.text.append(data)

    def finish(self) -> list[dict]:
        self.close()
        self.flush()
        self.caption = -1  # never closed: its text stays text
        self.end_figure()
        return [{"pos": i} | x for i, x in enumerate(self.out)]


def sequence(page: str | None) -> list[dict]:
    """The ordered text and media items of one page."""
    parser = _Sequence()
    parser.feed(page or "")
    return parser.finish()


def interleave(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages and _sequence."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(sequence)

    @F.pandas_udf(SEQUENCE)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(run)(batches)

    small_batches(pages.sparkSession)
    rows = pages.select(packed(pages).alias("_row"), parse(col(html_col)).alias("_new"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in pages.columns if c != "_sequence"], F.col("_new").alias("_sequence"))


def payload(text: str | None) -> bytes:
    """UTF-8 bytes padded to a positive multiple of a tile."""
    raw = (text or "").encode()
    return raw.ljust(max(TILE, -(-len(raw) // TILE) * TILE), bytes([PAD]))


def payload_of(text: Column) -> Column:
    """payload() as an expression."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    size = F.greatest(F.lit(TILE), F.ceil(n / TILE) * TILE)
    return F.concat(raw, F.unhex(F.repeat(F.lit(f"{PAD:02X}"), (size - n).cast("int"))))


def encode(samples: bytes) -> bytes:
    """Samples as a graymap, WIDTH to a row."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(samples) // WIDTH) + samples


def decode(stored: bytes) -> np.ndarray:
    """The samples of a graymap, row by row."""
    magic, size, top, rest = stored.split(b"\n", 3)
    wide, high = map(int, size.split())
    if magic != b"P5" or top != b"255" or len(rest) != wide * high:
        raise ValueError("not a graymap of 8-bit samples")
    return np.frombuffer(rest, np.uint8).reshape(high, wide)


def feature(samples: np.ndarray) -> str:
    """Height, mean, eight-bin histogram and a 64-bit average hash over an 8 x 8 grid of cell means."""
    bins = np.bincount(samples.ravel() >> 5, minlength=8)
    rows = np.linspace(0, samples.shape[0], 9).astype(int)
    cells = np.add.reduceat(np.add.reduceat(samples.astype(np.int64), rows[:-1], axis=0), np.arange(0, WIDTH, 3), axis=1) / (np.diff(rows) * 3)[:, None]
    bits = "".join("1" if x else "0" for x in (cells > cells.mean()).ravel())
    return f"h={samples.shape[0]};mean={samples.mean():.6f};hist={','.join(map(str, bins))};ahash={int(bits, 2):016x}"


MEDIA = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """The written table (digest, stored) of a binary column: each payload once for each task that meets it. Null payloads are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[bytes] = set()
        for batch in batches:
            new = {}
            for raw in batch["_raw"]:
                d = hashlib.sha256(raw).digest()
                if d not in met and d not in new:
                    new[d] = encode(raw)
            met.update(new)
            if len(met) > MET:
                met.clear()
            yield pd.DataFrame({"digest": [d.hex() for d in new], "stored": list(new.values())})

    small_batches(payloads.sparkSession)
    rows = payloads.select(col(payload_col).alias("_raw")).where("_raw is not null")
    return cut(rows.mapInPandas(tidy(run), "digest string, stored binary"), codec="zstd")


#: Digests that a task remembers; beyond them a payload may be stored again.
MET = 1 << 17


def described(media: DataFrame) -> DataFrame:
    """(digest, stored) to MEDIA, a row for each digest, from the samples read back."""

    def one(digest: str, stored: bytes) -> tuple:
        samples = decode(stored)
        back = samples.tobytes()
        return digest, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in MEDIA.split(", ")]
        for batch in batches:
            yield pd.DataFrame([one(d, s) for d, s in zip(batch["digest"], batch["stored"])], columns=names)

    small_batches(media.sparkSession)
    rows = media.select("digest", "stored").mapInPandas(tidy(run), MEDIA)
    return rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in rows.columns[1:]])


def pages_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _n_bytes, _html): a page for each document: its lines are paragraphs, and a figure after the first one refers to its payload by digest."""
    text = F.coalesce(col(text_col), F.lit(""))
    lines = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first = F.substring_index(lines, "\n", 1)
    rest = F.replace(F.substr(lines, F.char_length(first) + 2), F.lit("\n"), F.lit("</p><p>"))
    n = F.octet_length(text).cast("long")
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), F.sha2(payload_of(text), 256), F.lit('" alt=""><figcaption>payload of '), n.cast("string"), F.lit(" bytes</figcaption></figure>"))
    page = F.concat(F.lit("<article><p>"), first, F.lit("</p>"), figure, F.lit("<p>"), rest, F.lit("</p></article>"))
    return docs.select(col(id_col).alias("_id"), n.alias("_n_bytes"), page.alias("_html"))


def resolve(pages: DataFrame, media: DataFrame) -> DataFrame:
    """pages, each media struct of whose _sequence has `media`, the row of the media table (a row for each digest) with its digest, or null.

    Order, positions, captions and text structs stay as they are, and pages without media too.
    """
    rows = pages.select(packed(pages).alias("_row"))
    asked = F.array_distinct(F.transform(F.filter(F.col("_row._sequence"), lambda s: s["kind"] == "media"), lambda s: s["digest"]))
    rows = rows.withColumn("_key", F.when(F.size(asked) > 0, F.xxhash64(asked)))
    lists = rows.where("_key is not null").select("_key", F.explode(asked).alias("digest")).distinct()
    known = media.select("digest", F.struct(*[c for c in media.columns if c != "digest"]).alias("_media"))
    found = cut(lists.join(cut(known), "digest").groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("digest", "_media"))).alias("_found")))
    joined = rows.join(found, "_key", "left")

    def put(s: Column) -> Column:
        return F.struct(*[s[c].alias(c) for c in ("pos", "kind", "text", "digest", "caption")], F.try_element_at(F.col("_found"), s["digest"]).alias("media"))

    done = joined.select("_row", F.transform(F.col("_row._sequence"), put).alias("_new"))
    return done.select(*[F.col("_row")[c].alias(c) for c in pages.columns if c != "_sequence"], F.col("_new").alias("_sequence"))


def folded(items: Column) -> Column:
    """A sequence in which each stretch of texts between media is one text struct, at the place of its first, whose `digest` is the SHA-256 of its texts' SHA-256s, a line for each.

    What sequence_digest() needs of whole texts is 64 characters a stretch, so they needn't be shuffled to be resolved.
    """

    def stretch(own: Column) -> Column:
        sha = F.sha2(F.array_join(F.transform(own, lambda s: F.sha2(s["text"], 256)), "\n"), 256)
        return F.when(F.size(own) > 0, F.struct(own[0]["pos"].alias("pos"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("text"), sha.alias("digest"), F.lit(None).cast("string").alias("caption")))

    def between(media: Column) -> Column:
        place = lambda k: F.when(k < 0, -1).when(k < F.size(media), F.get(media, k)["pos"]).otherwise(F.size(items))
        each = lambda k: F.array(let(F.slice(items, place(k - 1) + 2, place(k) - place(k - 1) - 1), stretch), F.get(media, k))
        return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.size(media)), each)), lambda s: s.isNotNull())

    return let(F.filter(items, lambda s: s["kind"] == "media"), between)


def sequence_digest(items: Column) -> Column:
    """SHA-256 of a folded and resolved sequence: a line for each item, its place, kind, digest (and stored form, for media) and caption."""

    def line(s: Column) -> Column:
        body = F.when(s["kind"] == "text", s["digest"]).otherwise(F.concat_ws(" ", F.coalesce(s["digest"], F.lit("")), F.coalesce(s["media"]["media_sha256"], F.lit(""))))
        return F.concat_ws("\t", s["pos"].cast("string"), s["kind"], body, F.coalesce(s["caption"], F.lit("")))

    return F.sha2(F.array_join(F.transform(items, line), "\n"), 256)


def op10_media(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    media = described(store(docs.select(payload_of(F.col("text")).alias("payload"))))
    pages = interleave(pages_of(docs), "_html").select("_id", "_n_bytes", F.size("_sequence").alias("_items"), folded(F.col("_sequence")).alias("_sequence"))
    rows = resolve(pages, media).select("*", F.filter("_sequence", lambda s: s["kind"] == "media")[0].alias("_m"))
    measures = [F.col(f"_m.media.{x.split()[0]}") for x in MEDIA.split(", ")[1:]]
    return rows.select(F.col("_id").alias("doc_id"), F.col("_n_bytes").alias("n_bytes"), *measures, F.col("_m.pos").alias("position"), F.col("_m.caption").alias("caption"),
        F.col("_items").alias("items"), sequence_digest(F.col("_sequence")).alias("sequence_sha256"))
