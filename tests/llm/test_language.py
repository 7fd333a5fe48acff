import random

import numpy as np
import pytest

from convoloom.llm import language as g

TEXT = {
    "en": "The cache layer was built before the export job had finished loading. We should write a test for the file watcher first. Nothing tells us which of the two copies is newer.",
    "de": "Der Zwischenspeicher wurde gelesen, bevor alles vollständig geladen war. Wir sollten zuerst einen Test dafür schreiben. Nichts verrät uns, welche der beiden Kopien neuer ist.",
    "fr": "La mémoire a été lue avant que le reste ne soit chargé. Il faudrait d'abord écrire un test pour cela. Rien ne dit laquelle des deux copies est la plus récente.",
    "es": "La memoria se leyó antes de que todo hubiera terminado de cargar. Deberíamos escribir primero una prueba. Nada indica cuál de las dos copias es más reciente.",
    "pt": "A memória foi lida antes de o resto estar carregado. Devíamos escrever primeiro um teste. Nada nos diz qual das duas cópias é a mais recente.",
    "zh": "缓存层在加载完成之前就被读取了。我们应该先写一个测试。无法判断两份副本哪一份更新。",
}


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(0)
    docs = [(k, t) for k, t in TEXT.items() for _ in range(8)]
    # an eighth of the labels is wrong
    docs = [(rng.choice(g.LANGS), t) if i % 8 == 0 else (k, t) for i, (k, t) in enumerate(docs)]
    return g.train(docs)


def test_code_lengths_are_those_of_the_tree(trees):
    """Against a plain walk down the contexts of the stored tables."""

    def slow(text, lang):
        total, i_lang = 0.0, g.LANGS.index(lang)
        for n, sym in enumerate(text):
            for order, pk, pb, ck, cb in trees.levels:
                ctx = 0
                for k in range(order, 0, -1):
                    ctx = ctx << 8 | (text[n - k] if n >= k else 0)
                at = np.searchsorted(pk, np.uint64(ctx << 8 | sym))
                if at < len(pk) and int(pk[at]) == ctx << 8 | sym and np.isfinite(pb[at][i_lang]):
                    total += pb[at][i_lang]
                    break
                at = np.searchsorted(ck, np.uint64(ctx))
                if at < len(ck) and int(ck[at]) == ctx:
                    total += cb[at][i_lang]
            else:
                total += 8
        return total

    for t in ("the cache layer", "der test ist neu", "xyzq", "é"):
        got = trees.code_lengths([t.encode()])[0]
        for i, lang in enumerate(g.LANGS):
            assert abs(got[i] - slow(t.encode(), lang)) < 1e-2


def test_wrong_labels_dont_stick(trees):
    reader = g.Reader(trees.levels)
    for lang, text in TEXT.items():
        assert [s[0] for s in reader.segments([text])[0]] == [lang]


def test_segments_and_places(trees):
    a, b = TEXT["en"], TEXT["es"]
    doc = f"---\nid: 5\n---\n# {a}\n```py\nimport os\nla memoria se leyó antes\n```\n10:22:01.000 INFO x code=1 0xff\n{b} {a.replace('file watcher', '„la mémoire a été lue avant que le reste ne soit chargé“')}\n[Tool: Read File]\nFile: /a\nStatus: ✓ completed"
    got = g.Reader(trees.levels).segments([doc])[0]
    assert [s[0] for s in got] == ["en", "es", "en"]
    assert [doc[s[1] - 1 : s[2]].strip()[:12] for s in got] == ["# The cache ", "La memoria s", "The cache la"] and all(0.9 < s[3] <= 1 for s in got)


def test_no_prose(trees):
    for text in (None, "", "\n\n", "```\ncode here is no prose at all.\n```", "12:00:00.000 ERR x", "===", "42"):
        assert g.Reader(trees.levels).segments([text]) == [[]]


@pytest.mark.parametrize("label, lang", [("en", "en"), ("EN-us", "en"), (" English ", "en"), ("deu", "de"), ("Français", "fr"), ("pt_BR", "pt"), ("中文", "zh"), ("zh-Hant", "zh"), ("??", None), ("und", None), ("", None), (None, None), ("unknown", None)])
def test_labels(spark, label, lang):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(label,)], "l string").select(g.label_of(F.col("l"))).first()[0] == lang


def test_frame(spark):
    rows = [(i, TEXT[k], k, "clash") for i, k in enumerate(list(TEXT) * 6)] + [(100, TEXT["de"], "fr", ""), (101, TEXT["en"] + " " + TEXT["pt"], "en", ""), (102, None, "en", ""), (103, TEXT["zh"], None, ""), (104, TEXT["en"] * 200, "English", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, segments string")
    got = {r["doc_id"]: [s["lang"] for s in r["segments"]] for r in g.read_languages(df, "doc_id", "text", "lang").collect()}
    assert got[100] == ["de"] and got[101] == ["en", "pt"] and got[102] == [] and got[103] == ["zh"] and got[104] == ["en"]
    assert g.read_languages(df.limit(0), "doc_id", "text", "lang").count() == 0
    none = g.read_languages(df.withColumn("lang", F_null()), "doc_id", "text", "lang")
    assert all(r["segments"] == [] for r in none.collect())


def F_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def test_held_out_labels(spark, sf):
    """On documents with one segment, labels that name a language agree with it as often as the table's labels are right."""
    got = g.read_languages(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", "lang").collect()
    one = [r for r in got if len(r["segments"]) == 1 and r["label"]]
    assert sum(r["label"] == r["segments"][0]["lang"] for r in one) / len(one) > 0.8


def test_training_takes_distinct_whole_texts(spark):
    hot = "A hot text that many rows repeat. " * 700
    rows = [("en", hot)] * 300 + [("en", f"English text number {i}.") for i in range(60)] + [("de", f"Deutscher Text Nummer {i}.") for i in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = g.training_sample(df, "text", "lang", 1000)
    assert sorted(got) == sorted(set(rows))
    some = g.training_sample(df, "text", "lang", 10)
    assert len(some) == len(set(some)) == 20 and {k: sum(x == k for x, _ in some) for k in ("en", "de")} == {"en": 10, "de": 10}
    assert g.training_sample(df.orderBy("text").repartition(3), "text", "lang", 10) == some


def test_main_languages(spark):
    schema = "doc_id bigint, label string, segments array<struct<seg_no:int,lang:string,start_pos:int,end_pos:int,confidence:double>>"
    rows = [(1, "de", [(1, "de", 1, 30, 0.9), (2, "en", 31, 40, 0.8), (3, "de", 41, 100, 1.0)]), (2, None, []), (3, "fr", [(1, "zh", 5, 9, 0.7)])]
    got = [tuple(r) for r in g.main_languages(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()]
    assert got == [(1, "de", "de", 0.9, 1.0, 3), (2, None, None, None, None, 0), (3, "fr", "zh", 1.0, 0.7, 1)]


def test_main_languages_agree_with_the_segments(spark, sf):
    """Against a plain count in Python over the whole table."""
    from collections import Counter

    want = {}
    for r in g.read_languages(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", "lang").collect():
        size = Counter()
        for s in r["segments"]:
            size[s["lang"]] += s["end_pos"] - s["start_pos"] + 1
        best = max(size, key=lambda k: (size[k], k), default=None)
        confidence = max((s["confidence"] for s in r["segments"] if s["lang"] == best), default=None)
        want[r["doc_id"]] = (r["label"], best, round(size[best] / sum(size.values()), 6) if best else None, confidence, len(r["segments"]))
    got = {r["doc_id"]: tuple(r)[1:] for r in g.p10_languages(spark, sf).collect()}
    assert got == want and all(c is None or 0 < c <= 1 for _, _, _, c, _ in got.values())
