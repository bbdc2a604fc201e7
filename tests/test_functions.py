import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.functions import bits, codecs, geo, rules, text


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in df.select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()]


STREETS = [
    ("Main St", "main street"), ("MAIN STREET", "main street"), ("N. Oak Ave.", "north oak avenue"), ("5th Blvd", "5th boulevard"), ("Café Rd", "cafe road"), ("", ""), (None, ""),
    ("SW Mt Hood Hwy", "southwest mount hood highway"), ("Rue de l'Été", "rue de l ete"), ("  Elm   Ct ", "elm court"),
]


def test_street_key(spark):
    key = lambda v: text.street_key(text.fold(v))
    assert column(spark, [s for s, _ in STREETS], "string", key) == [k for _, k in STREETS]
    once = [k for _, k in STREETS]
    assert column(spark, once, "string", key) == once  # idempotent


def folded(s):
    return None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


def test_fold_of_every_character(spark):
    """Each assigned character alone."""
    chars = [chr(p) for p in range(1, 0x110000) if not 0xD800 <= p <= 0xDFFF and unicodedata.category(chr(p)) not in ("Cn", "Co")]
    got = column(spark, chars, "string", text.fold)
    assert [(c, a, folded(c)) for c, a in zip(chars, got) if a != folded(c)] == []


def test_fold_of_mixed_strings(spark):
    rng = random.Random(5)
    pools = ["abcXYZ 09-", "éÀßøŁİıǅ", "\u0301\u0307\u0345\u064e\u05b0", "ﬁ½㌀ﷺ①Ⅷ", "한국어갛힣", "ばガﾊﾞ東京", "ПушкинЙё", "ΑΣΟΣς", "𝐀𝟙😀"]
    strings = [None, "", "ΟΔΟΣ", "ﷺﷺ", "각a각"] + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 20))) for _ in range(4000)]
    assert column(spark, strings, "string", text.fold) == [folded(s) for s in strings]


def test_fold_needs_no_python_worker(spark):
    plan = spark.range(3).select(text.fold(F.col("id").cast("string")).alias("f"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_title_case(spark):
    rng = random.Random(6)
    pools = ["abcXYZ", "'-. 0123_", "éÀøŁ", "ПушкинЙё", "東京", "ß"]
    strings = [None, "", "O'BRIEN'S 3RD ST", "l'isle-d'abeau", "NATION_0"] + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 16))) for _ in range(3000)]
    assert column(spark, strings, "string", text.title_case) == [None if s is None else s.title() for s in strings]


def test_no_abbreviation_hides_a_word():
    assert not set(text.STREET_WORDS) & set(text.STREET_WORDS.values())


def test_prefix_key(spark):
    got = column(spark, ["tokyo", "a", "", "_private", "東京", "пушкин", "a東", "45 b", "é"], "string", lambda v: text.prefix_key(text.fold(v)))
    assert got == ["to", "a_", "__", "_p", "u6771", "u43f", "a_", "45", "e_"]


def fnv(s, n):
    h = 2166136261
    for b in s.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h % n


@pytest.mark.parametrize("n", [4, 8, 16, 32])
def test_fnv(spark, n):
    words = ["", "a", "Main Street", "大阪", "القاهرة", "ירושלים", "Москва", "😀", "São Paulo", "x" * 300]
    assert column(spark, words, "string", lambda v: text.fnv1a(v, n)) == [fnv(w, n) for w in words]


def test_cells_are_floored(spark):
    assert column(spark, [0, -1, -1224001000, 1224001000], "long", lambda v: geo.cell(v, 10)) == [0, -1, -1225, 1224]
    assert column(spark, [-5_000_000, 5_000_000], "long", lambda v: geo.cell_trunc(v, 1)) == [0, 0]


def test_representative_point(spark):
    rows = [("Point", [[[1.0, 2.0]]]), ("LineString", [[[0.0, 0.0], [1.0, 1.0], [5.0, 5.0]]]), ("MultiLineString", [[[9.0, 9.0]], [[0.0, 0.0], [3.0, 3.0]]]), ("Polygon", [[[0.0, 0.0], [2.0, 0.0], [1.0, 3.0]]]), ("Other", [[[1.0, 1.0]]]), ("Point", [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, c array<array<array<double>>>")
    got = [r.p for r in df.select("i", geo.representative_point(F.col("k"), F.col("c")).alias("p")).orderBy("i").collect()]
    assert got == [[1.0, 2.0], [1.0, 1.0], [3.0, 3.0], [1.0, 1.0], None, None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**31), 2**31 - 1), st.integers(-(2**31), 2**31 - 1)), max_size=20))
def test_lines_survive_coding(points):
    assert codecs.unpack_line(codecs.pack_line(points)) == points


def test_zigzag(spark):
    values = [0, -1, 1, -2, 2**31 - 1, -(2**31)]
    assert column(spark, values, "long", bits.zigzag) == [0, 1, 2, 3, 2**32 - 2, 2**32 - 1]
    assert column(spark, values, "long", lambda v: bits.unzigzag(bits.zigzag(v))) == values


def test_piece_size(spark):
    def want(n):
        raw, size = max(n // 1500, 16384), 1
        while size < raw:
            size *= 2
        return min(max(size, 2**18), 2**23)

    sizes = [0, 1, 10**6, 393_216_000, 393_217_500, 10**9, 10**10, 10**12]
    assert column(spark, sizes, "long", bits.piece_size) == [want(n) for n in sizes]


def test_gunzip(spark):
    import gzip

    blobs = [gzip.compress(b"abc"), b"plain", gzip.compress(b"abc" * 99)[:15], None]
    assert column(spark, blobs, "binary", codecs.gunzip) == [b"abc", b"plain", None, None]


def test_bbox(spark):
    got = column(spark, ["1, 2, 3, 4.5", "1,2,3", "a,b,c,d", None], "string", codecs.parse_bbox)
    assert (got[0].lon, got[0].lat, got[0].zoom) == (2.0, 3.25, 8) and got[1:] == [None, None, None]


def test_address_parts(spark):
    got = column(spark, ["12 Main St, Rome", "Main", "Main, Rome", "12 Main"], "string", text.parse_address)
    assert [(g.num, g.street, g.city) for g in got] == [("12", "Main St", "Rome"), ("", "Main", ""), ("Main,", "Rome", ""), ("12", "Main", "")]


CHIP_CASES = [("poi", "thai_restaurant", "x", "restaurants"), ("poi", "tourism", "City Museum", "museums"), ("poi", "tourism", "City", None), ("park", "garden", "x", "parks"), ("street", "bar", "x", None), ("poi", "wine_bar", "x", "bars"), ("poi", "book_store", "x", "shops")]


def test_chips(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(CHIP_CASES)], "i int, t string, s string, n string, want string")
    for r in df.select("want", rules.chips_of(F.col("t"), F.col("s"), F.col("n")).alias("got")).collect():
        assert r.got == ([r.want] if r.want else [])


def test_shorten(spark):
    def want(s):
        if len(s) <= 500:
            return s
        at = s[:500].rfind(". ")
        return s[: at + 1] if at > 200 else s[:500] + "..."

    random.seed(3)
    texts = ["".join(random.choice("abc. ") for _ in range(n)) for n in (10, 499, 500, 501, 900, 2000)] + ["x" * 700, "y" * 100 + ". " + "z" * 600]
    assert column(spark, texts, "string", text.shorten) == [want(s) for s in texts]
