"""Column functions on the literals of the data model."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import arrays as A
from corpusmill.functions import hashing as H
from corpusmill.functions import kernels, markers
from corpusmill.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, want", [(0, 0xE220A8397B1DCDAF), (1, 0x910A2DEC89025CC1), (0xFFFFFFFF, 0x73B13BA2AFF181C0)])
def test_splitmix(spark, value, want):
    df = H.with_splitmix64(spark.createDataFrame([(value,)], "v long"), "v", "h")
    assert df.select(H.unsigned_text(F.col("h"))).first()[0] == f"{want:016x}"


@pytest.mark.parametrize("key, shard, split, sample, stem", [("song_000", 135, 5935, 58, 20), ("song_001", 34, 1333, 59, 51), ("ünïçødé", 200, 906, 30, 66)])
def test_hash_values(spark, key, shard, split, sample, stem):
    k = F.lit(key)
    got = spark.range(1).select(H.shard_of(k), H.sha1_bucket(k, 10_000, "42:"), H.sha1_bucket(k, 100, "sample:"), H.sha1_bucket(k, 100, "stem-sample:")).first()
    assert tuple(got) == (shard, split, sample, stem)


def test_samples_grow(spark):
    keys = spark.range(20_000).select(F.format_string("wave_%07d", "id").alias("k"))
    got = keys.agg(*[F.avg(H.sampled(F.col("k"), p).cast("int")) for p in (0, 30, 60, 100)], F.count(F.when(H.sampled(F.col("k"), 30) & ~H.sampled(F.col("k"), 60), 1))).first()
    assert got[0] == 0 and abs(got[1] - 0.3) < 0.02 and abs(got[2] - 0.6) < 0.02 and got[3] == 1 and got[4] == 0


@pytest.mark.parametrize("text, want", [
    ("Am", "a_minor"), ("a minor", "a_minor"), ("key:Am", "a_minor"), ("F# major", "f_sharp_major"), ("Bb", "a_sharp_major"), ("Db minor", "c_sharp_minor"), ("cb", "b_major"), ("e#", "f_major"),
    ("hello", None), (None, None), ("", None),
])
def test_parse_key(spark, text, want):
    assert one(spark, X.parse_key(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("120bpm", 120.0), ("120", 120.0), ("tempo:128", 128.0), (None, None), ("0", None), ("-5", None), ("fast", 160.0), ("slow", 65.0), ("quick", None)])
def test_parse_tempo(spark, text, want):
    assert one(spark, X.parse_tempo(F.lit(text))) == want


@pytest.mark.parametrize("bpm, want", [(40, 80), (50, 100), (59, 118), (75, 75), (120, 120), (150, 150), (181, 90.5), (200, 100), (240, 120), (30, 60), (180, 90), (60, 60), (720, 90)])
def test_octave_fold(spark, bpm, want):
    assert one(spark, X.octave_fold(F.lit(float(bpm)))) == pytest.approx(want)


def test_tempo_buckets(spark):
    b = [one(spark, X.tempo_bucket(F.lit(v).cast("double"))) for v in (None, 0, -5, float("nan"), 59, 60, 61)]
    assert b == [-1, -1, -1, -1, 0, 1, 1]


@pytest.mark.parametrize("text, n, logprob, want", [
    ("Thank you.", 2, -0.1, "short"), ("oh", 1, -0.1, "short"), ("Thank you for watching! " * 3, 12, -0.1, "junk:thank you for watching"), ("la " * 40 + "thank you for watching", 44, -0.1, None),
    ("many good words are in here now", 7, -3.0, "low_confidence"),
])
def test_junk_reason(spark, text, n, logprob, want):
    assert one(spark, X.junk_reason(F.lit(text), F.lit(n), F.lit(logprob))) == want


def test_captions(spark):
    assert one(spark, X.gender_tag(F.lit("A song. gender - m"))) == "male"
    assert one(spark, X.gender_tag(F.lit("gender-bending pop"))) is None
    assert one(spark, X.clean_caption(F.lit('"A  quoted\n caption"'))) == "A quoted caption"
    assert one(spark, X.clean_caption(F.lit("word " * 20), 12)) == "word word"
    assert one(spark, X.clean_caption(F.lit("he said 'no'"))) == "he said 'no'" and one(spark, X.clean_caption(F.lit("''twice''"))) == "'twice'"
    assert one(spark, X.gender_tag(F.lit("GENDER: woman. More prose"))) == "female" and one(spark, X.gender_tag(F.lit("gender: instrumental"))) is None
    assert one(spark, X.before_gender_tag(F.lit("A song.\nGENDER: male"))) == "A song."
    lines = "A song.\n- Drums: dry  kit\nBASS - none.\ndrums: again\n* Vocals: a choir\nGENDER: male"
    assert one(spark, X.stem_captions(F.lit(lines))) == ["dry kit", "", "a choir", ""]


@pytest.mark.parametrize("text, header, body", [
    ("[male] [female] la", {"gender": "male", "vocals": "vocals"}, ["la"]), ("[120bpm] [Am] x", {"tempo": "120", "key": "a_minor", "vocals": "vocals"}, ["x"]),
    ("[fast] [french] [instrumental]", {"tempo": "160", "language": "fr", "vocals": "instrumental"}, []), ("[f] [lang:de] [what] [verse] y", {"gender": "female", "language": "de", "vocals": "vocals"}, ["verse", "y"]),
    ("a [male] b [] [[solo]] c", {"vocals": "vocals"}, ["a", "b", "solo", "c"]), (None, {}, []), ("[bridge]", {"section": "bridge"}, []), ("[mixed] z", {"vocals": "vocals"}, ["z"]),
])
def test_marker_headers(text, header, body):
    got, rest = markers.parse_markers(text)
    assert got == markers.DEFAULTS | header and [v for _, v in rest] == body


def test_labels(spark):
    ask = lambda f, *xs: [one(spark, f(F.lit(x).cast("string"))) for x in xs]
    assert ask(X.gender_label, "Boy", "women", "mixed", None) == ["male", "female", "unknown_gender", "unknown_gender"]
    assert ask(X.vocal_label, "no vocals", "Sung", "inst") == ["instrumental", "vocals", "unknown_vocals"]
    assert ask(X.language_code, "lang:fr", "Mandarin", "language: German", "xx", None) == ["fr", "zh", None, None, None]
    assert ask(X.parse_key, "g-flat minor", "c_sharp_minor", "♭h", "unknown_key") == ["f_sharp_minor", "c_sharp_minor", None, "unknown_key"]
    assert ask(X.fingerprint, "DURATION=3\nFINGERPRINT=1,-2,3", "none") == [[1, -2, 3], []]
    assert ask(X.stem_list, "Vox, drums,voice,") == [["vocals", "drums"]]
    assert ask(X.sanitised, ' "a  b" ', "x " * 300)[0] == "a b"


def test_crossfade(spark):
    f = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert one(spark, A.crossfaded(f(1, 1, 1), f(2, 2), 2)) == pytest.approx([1, 1, 2]) and one(spark, A.crossfaded(f(1), f(2), 0)) == [1, 2]
    assert one(spark, A.crossfaded(f(1, 1, 1, 1), f(3, 3, 3), 3))[2] == pytest.approx((1 + 3) / 2**0.5)


def test_signal_gate(spark):
    from corpusmill.operators import quality as Q

    def verdict(xs, rate, bit_rate=None):
        df = spark.createDataFrame([(xs, rate, bit_rate)], "x array<double>, r int, b int").withColumns(Q.signal_figures(F.col("x"), F.col("r")))
        return df.select(Q.signal_reasons(F.col("clip_ratio"), F.col("silent_ratio"), F.col("rms_dbfs"), F.col("b"))).first()[0]

    tone = [0.25 if k % 2 else -0.25 for k in range(400)]
    assert verdict(tone, 100) == [] and verdict([], 100) == [] and verdict([0.5], 100) == []
    assert verdict([1.0] * 400, 100) == ["clipped(100.0%>2%)"] and verdict([0.995] * 10 + [0.5] * 390, 100) == ["clipped(2.5%>2%)"]
    assert verdict(tone[:100] + [0.0] * 300, 100) == ["silent(75%>60%)"] and verdict([0.001] * 400, 100)[-1] == "dead(-60dBFS<-40)"
    assert verdict(tone, 100, 64_000) == ["lowbitrate(64k<96k)"]


def test_clamped_spans(spark):
    def clamp(spans):
        df = spark.createDataFrame([(spans,)], "s array<struct<start: double, end: double>>")
        return [None if x is None else tuple(x) for x in df.select(A.clamp_spans(F.col("s"))).first()[0]]

    assert clamp([(0.1, 0.5), (0.3, 0.9)]) == [(0.1, 0.5), (0.5, 0.9)]
    assert clamp([(2.0, 3.0), None, (2.5, 2.6)]) == [(2.0, 3.0), None, (3.0, 3.001)]
    assert clamp([]) == []

    def refine(spans, own):
        df = spark.createDataFrame([(spans, own)], "s array<struct<start: double, end: double>>, o array<struct<start: double, end: double>>")
        return [tuple(x) for x in df.select(A.clamp_spans(F.col("s"), own=F.col("o"))).first()[0]]

    assert refine([None, (2.5, 3.8)], [(1.0, 3.0), (3.1, 3.9)]) == [(1.0, 3.0), (3.0, 3.8)]
    assert refine([(0.0, 1.0)], [(1.0, 3.0), (3.1, 3.9)]) == [(1.0, 3.0), (3.1, 3.9)]


def test_delay_pattern_has_an_inverse(spark):
    rows = [(k, list(range(k * 5, k * 5 + 5))) for k in range(9)]
    df = spark.createDataFrame(rows, "k int, r array<int>")
    for k, r in rows:
        d = df.where(F.col("k") == k).select(A.delay_row(F.col("r"), k, 9, -1).alias("d"))
        got = d.select("d", A.undelay_row(F.col("d"), k, 9)).first()
        assert len(got[0]) == 13 and got[0][k : k + 5] == r == got[1]


def test_sequences(spark):
    assert A.ladder([1.0, 2.0], 3) == [1.0, 1.5, 2.0] and A.ladder([10, 1], 4, whole=True) == [10, 7, 4, 1]
    xs = F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))
    assert one(spark, A.resample(xs, 5)) == [0.0, 0.5, 1.0, 1.5, 2.0]
    assert one(spark, A.cosine(xs, xs)) == pytest.approx(1.0)
    assert one(spark, A.guided(F.lit(1.0), F.array(F.lit(0.0), F.lit(2.0)), F.array(F.lit(0.5)))) == 2.0


def test_markers(spark):
    header, body = markers.parse_markers("[Tempo:120] [female] [Verse] hello world [chorus] yeah [nonsense] [brok en")
    assert header["tempo"] == "120" and header["gender"] == "female" and header["section"] == "verse" and header["key"] == "unknown_key"
    assert body == [("word", "hello"), ("word", "world"), ("section", "chorus"), ("word", "yeah"), ("section", "no_section"), ("word", "brok"), ("word", "en")]
    df = markers.with_markers(spark.createDataFrame([("[verse] a",), (None,)], "t string"), "t").collect()
    assert df[0]["body"][0]["value"] == "a" and df[1]["body"] == []


def test_kernels(spark):
    assert [kernels.word_errors(a, b) for a, b in (("a b c", "a b c"), ("a b c", "a x c d"), ("", "a"), ("a b", ""))] == [0, 2, 1, 2]
    df = spark.createDataFrame([("g", "a b c", "a b c"), ("g", "a", "b c")], "g string, r string, s string")
    got = kernels.corpus_word_error_rate(df, "r", "s", ["g"]).first()
    assert got["pooled"] == 0.5 and got["mean"] == 1.0
    forms = spark.createDataFrame([("Hello,",), ("don't",), ("123",), ("Café",), (None,)], "w string").select(kernels.align_form("w")).collect()
    assert [r[0] for r in forms] == ["hello", "don't", "", "café", None]
    rows = {r["k"]: r for r in kernels.mapped(spark.createDataFrame([(1, "a"), (2, None)], "k long, v string"), "k", "v", "upper").collect()}
    assert rows[1]["result"] == "A" and rows[2]["error"].startswith("AttributeError")
    kernels.register(spark)
    assert spark.sql("select word_errors('a b', 'a')").first()[0] == 1
    assert isinstance(pd.Timestamp(datetime(2020, 1, 1) + timedelta(1)), pd.Timestamp)
