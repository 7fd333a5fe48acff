"""Languages of documents and of the segments of mixed ones, by prediction by partial matching.

A variable-order context tree over bytes is trained for each language from a bounded sample of labelled documents,
cleaned by its own verdicts in a second round, because labels may be wrong. The statistics are then frozen: the
exact code length of a text under a language is the sum of what its symbols cost in their longest known contexts,
with escape costs (method C) on the way down. Trees are stored as sorted arrays of packed contexts with one column for
each language, so a whole batch of sentences is scored by array lookups. Sentences are compared after code, quoted
phrases, digits and names of identifiers are taken out; equal sentences are scored once per worker, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.session import settle, table

LANGS = ("de", "en", "es", "fr", "pt", "zh")
# Usual spellings of labels, compared in lower case up to the first - or _.
SPELLINGS = {
    "de": "de deu ger german deutsch allemand alemán alemão",
    "en": "en eng english englisch anglais inglés inglês",
    "es": "es spa spanish español espanol castellano castilian spanisch espagnol espanhol",
    "fr": "fr fra fre french français francais französisch francés francês",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués",
    "zh": "zh zho chi cmn yue chinese mandarin 中文 汉语 漢語 chinesisch chinois chino chinês",
}
LABELS = {s: k for k, v in SPELLINGS.items() for s in v.split()}

ORDER = 5
#: Documents of each label in the training sample, about: the only rows the trees are grown from.
SAMPLE = 400
#: Training bytes of each language at most.
TRAIN_BYTES = 120_000
#: Bits by which the best language must lead for a sentence to count by itself; below, it follows its neighbours.
LEAD = 6.0
#: Characters of sentences remembered by a worker; with more it forgets all and starts anew.
REMEMBER = 16_000_000


def label_of(lang):
    """Column: the language a label names, or null."""
    first = F.lower(F.trim(F.regexp_replace(lang, r"[\s ]+", " ")))
    head = F.regexp_extract(first, r"^([^-_. (]*)", 1)
    return F.element_at(F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, v)]), head)


#: Lines that are no prose: logs, tools, requests, statements, rules, headings without letters, code. Every part reads a line once.
NOT_PROSE = regex.compile(
    r"^\s*+(?:\d{1,2}:\d{2}:\d{2}\b|\d{4}-\d\d-\d\d[T ]\d|\[(?:Tool|Thinking|Error)\b|(?:File|Status|Path|Command|id)\s*+:\s|(?:GET|POST|PUT|DELETE)\s++/|(?:SELECT|INSERT INTO|UPDATE|DELETE FROM|WHERE)\s++\S"
    r"|(?:Author|Signed-off-by|Reviewed-by):\s|[\[{<]|[=\-_*#~]{3,}+\s*+$|#{1,6}+\P{L}*+$|(?:def|class|import|from|const|let|var|return|if|for|while)\b[^.?!\n]*+(?<=[:;({]))"
)
FENCE = regex.compile(r"^\s*(```|~~~)")
LINES = regex.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
ENDS = regex.compile(r"(?<![.!?…])[.!?…]++[\"'”’»)\]]*+(?=\s)|(?<![。！？])[。！？]++[”’」』）]*+")
#: Essences are taken from many sentences at once, one to a line, so no pattern may cross a line's end. Each reads a character a bounded number of times, however long a word or quotation is.
QUOTED = regex.compile(r"`[^`\n]*+`|\"[^\"\n]*+\"|“[^“”\n]*+”|„[^“”„\n]*+[“”]|«[^«»\n]*+»|「[^「」\n]*+」|‘[^‘’\n]*+’|<[^<>\n]*+>")
ADDRESS = regex.compile(r"(?<!\S)[^\s/\\@\P{ASCII}]*+[/\\@][^\s\P{ASCII}]*+(?!\S)")
NAME = regex.compile(r"(?<![A-Za-z0-9_])[A-Z]*+(?:[a-z]++(?=[A-Z0-9_])|(?=[0-9_]))[A-Za-z0-9_]++")
JUNK = regex.compile(r"[^\p{L}\p{M}'’¿¡ \n]++")
BLANKS = regex.compile(r" {2,}+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of prose, by code points from 0: no fenced code, front matter, log, tool and header lines."""
    out, fenced, pos, head = [], False, 0, None
    bounds = [m.span() for m in LINES.finditer(text)] + [(len(text), len(text))]
    for n, (end, after) in enumerate(bounds):
        line = text[pos:end]
        bare = line.strip(" \t﻿​\xa0")
        if bare == "---" and (n == 0 or head):
            head = not head
        elif head and not regex.match(r"^[\w.-]+\s*:", bare):
            head = None
        if FENCE.match(bare):
            # a fence opens where the mark stands alone or with a name; behind it text may follow on the same line
            fenced = not fenced
            if not fenced and len(bare) > 3:
                line = line.replace("```", "   ", 1)
                bare = line.strip()
            else:
                bare = ""
        if bare and not fenced and not head and not NOT_PROSE.match(bare):
            at = 0
            for m in [*ENDS.finditer(line), None]:
                stop = m.end() if m else len(line)
                if line[at:stop].strip():
                    out.append((pos + at, pos + stop))
                at = stop
        pos = after
    return out


def essences(found: list[str]) -> list[str]:
    """What of each sentence tells its language, in lower case; words joined by single spaces. Code, quoted phrases, addresses, paths and names of identifiers are left out. Sentences have no line ends in them."""
    if not found:
        return []
    s = "\n".join(found)
    s = NAME.sub(" ", ADDRESS.sub(" ", QUOTED.sub(" ", s)))
    return [x.strip() for x in BLANKS.sub(" ", JUNK.sub(" ", s)).lower().split("\n")]


HAN = regex.compile(r"\p{Han}")


def telling(e: str) -> bool:
    return len(e) >= 6 or bool(HAN.search(e)) and len(e) >= 2


class Trees:
    """Frozen context trees: per order, contexts with escape costs and (context, symbol) pairs with code lengths."""

    def __init__(self, levels):
        self.levels = levels

    @staticmethod
    def keys(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
        """Packed bytes before each place, zero where the text hasn't begun."""
        out = np.zeros(len(data), np.uint64)
        since = np.arange(len(data)) - starts
        for k in range(order, 0, -1):
            before = np.zeros(len(data), np.uint64)
            before[k:] = data[:-k]
            before[since < k] = 0
            out = out << np.uint64(8) | before
        return out

    @staticmethod
    def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
        sizes = np.array([len(t) for t in texts], np.int64)
        return data, np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(len(texts)), sizes)

    @classmethod
    def grow(cls, texts: dict[str, list[bytes]], depth: int = ORDER) -> Trees:
        levels = []
        for order in range(depth, -1, -1):
            pairs, contexts = [], []
            for lang in LANGS:
                data, starts, _ = cls.joined(texts.get(lang) or [b" "])
                ctx = cls.keys(data, starts, order)
                pair, n = np.unique(ctx << np.uint64(8) | data, return_counts=True)
                context, first, kinds = np.unique(pair >> np.uint64(8), return_index=True, return_counts=True)
                total = np.add.reduceat(n, first)
                room = np.repeat(total + kinds, kinds)
                pairs.append((pair, -np.log2(n / room)))
                contexts.append((context, -np.log2(kinds / (total + kinds))))
            levels.append((order, *cls._table(pairs, np.inf), *cls._table(contexts, 0.0)))
        return cls(levels)

    @staticmethod
    def _table(parts, absent):
        keys = np.unique(np.concatenate([k for k, _ in parts]))
        values = np.full((len(keys) + 1, len(parts)), absent, np.float32)
        for i, (k, v) in enumerate(parts):
            values[np.searchsorted(keys, k), i] = v
        return keys, values

    @staticmethod
    def _row(keys, wanted):
        i = np.searchsorted(keys, wanted)
        i[i == len(keys)] = 0
        return np.where(keys[i] == wanted, i, len(keys))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        data, starts, which = self.joined(texts)
        cost = np.zeros((len(data), len(LANGS)), np.float32)
        open_ = np.ones((len(data), len(LANGS)), bool)
        for order, pair_keys, pair_bits, ctx_keys, ctx_bits in self.levels:
            ctx = self.keys(data, starts, order)
            bits = pair_bits[self._row(pair_keys, ctx << np.uint64(8) | data)]
            step = np.where(np.isfinite(bits), bits, ctx_bits[self._row(ctx_keys, ctx)])
            cost += np.where(open_, step, 0)
            open_ &= ~np.isfinite(bits)
        cost += np.where(open_, np.float32(8), 0)
        return np.stack([np.bincount(which, cost[:, i], len(texts)) for i in range(len(LANGS))], 1)


#: Depths of the trees by which training relabels sentences, one round each, before the last trees are grown.
DEPTHS = (1, 2, 3)
FOLDS = 4
#: Sentences at which codes of trees with and without a sentence count alike.
FEW = 200
#: How often a document's language is taken to be that of a sentence in it, or of its label, and one certain other.
RIGHT, WRONG = 0.7, 0.06


def train(docs: list[tuple[str, str]]) -> Trees:
    """Trees from (language, text) pairs whose labels may be wrong. Each round gives every document the language that codes the whole of it shortest, the labels voting, and every sentence the language that codes it shortest, its documents voting. Sentences are coded by all trees and by trees that were grown without them, so that none is kept by a language that has learnt it by heart under a wrong label."""
    ids: dict[bytes, int] = {}
    size = dict.fromkeys(LANGS, 0)
    sents, labels = [], []  # of each occurrence of a sentence, and of each document
    for lang, text in docs:
        mine = []
        for e in essences([text[a:b] for a, b in sentences(text)]):
            if size[lang] < TRAIN_BYTES and telling(e):
                key = e.encode()
                mine.append(ids.setdefault(key, len(ids)))
                size[lang] += len(key)
        if mine:
            sents.append(mine)
            labels.append(LANGS.index(lang))
    distinct, n = list(ids), len(LANGS)
    if not distinct:
        return Trees.grow({}, ORDER)
    fold = np.array([xxhash.xxh64_intdigest(e) % FOLDS for e in distinct])
    doc, sent, labels = np.repeat(np.arange(len(sents)), [len(x) for x in sents]), np.concatenate(sents), np.array(labels)
    said = lambda votes: -np.log2(WRONG) * votes.sum(1, keepdims=True) - np.log2(RIGHT / WRONG) * votes

    def counted(langs):
        """How often each sentence occurs in documents of each language."""
        return np.bincount(sent * n + langs[doc], minlength=len(distinct) * n).reshape(-1, n)

    def grow(weights, wanted, depth):
        return Trees.grow({lang: [distinct[k] for k in np.flatnonzero(wanted & (weights[:, i] > 0)) for _ in range(weights[k, i])] for i, lang in enumerate(LANGS)}, depth)

    summed = lambda table_: np.stack([np.bincount(doc, table_[sent, i], len(labels)) for i in range(n)], 1)
    weights = counted(labels)
    # what the labels say for a document: its own and those of the others that hold its sentences, on average
    label_votes = summed(weights) / np.bincount(doc)[:, None]
    # trees without a sentence know little about it while sentences are few
    trust = len(distinct) / (len(distinct) + FEW)
    for depth in DEPTHS:
        bits = grow(weights, fold >= 0, depth).code_lengths(distinct) * (1 - trust)
        for k in range(FOLDS):
            inside = np.flatnonzero(fold == k)
            if len(inside):
                bits[inside] += grow(weights, fold != k, depth).code_lengths([distinct[i] for i in inside]) * trust
        votes = counted((summed(bits) + said(label_votes)).argmin(1))
        best = (bits + said(votes)).argmin(1)
        weights = np.where(np.arange(n) == best[:, None], votes.sum(1, keepdims=True), 0)
    return grow(weights, fold >= 0, ORDER)


class Reader:
    """Segments of texts under frozen trees, with a memory of sentences seen: of each its best language, whether that leads clearly, and its bits under each language; None if it tells nothing."""

    def __init__(self, levels):
        self.trees, self.known, self.size = Trees(levels), {}, 0

    def learn(self, found: set[str]) -> None:
        new = [x for x in found if x not in self.known]
        if self.size + sum(map(len, new)) > REMEMBER:
            self.known, self.size, new = {}, 0, list(found)
        self.size += sum(map(len, new))
        told = dict(zip(new, essences(new)))
        distinct = list({e for e in told.values() if telling(e)})
        scored = {}
        for i in range(0, len(distinct), 4000):
            part = distinct[i : i + 4000]
            bits = self.trees.code_lengths([e.encode() for e in part]).round(2)
            low = np.partition(bits, 1, axis=1)
            scored.update(zip(part, zip(bits.argmin(1).tolist(), (low[:, 1] - low[:, 0] >= LEAD).tolist(), map(tuple, bits.tolist()))))
        self.known.update((x, scored.get(e)) for x, e in told.items())

    def segments(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """Of each text its segments (language, first place, end, confidence), places by code points from 1, end included."""
        spans = [sentences(t) if t else [] for t in texts]
        found = [[t[a:b] for a, b in s] for t, s in zip(texts, spans)]
        self.learn({x for row in found for x in row})
        return [join_sentences(s, [self.known[x] for x in row]) for s, row in zip(spans, found)]


def join_sentences(spans, told) -> list[tuple[str, int, int, float]]:
    """Longest runs of sentences in one language. A sentence without a clear lead joins the run before it, or the next one at the start, unless all are unclear."""
    runs = []  # language, first place, end, bits of its sentences
    waiting = []
    for (a, b), what in zip(spans, told):
        if what is None:
            continue
        best, clear, bits = what
        if clear and (not runs or runs[-1][0] != best):
            runs.append([best, waiting[0][0] if waiting else a, b, [w for _, _, w in waiting] + [bits]])
            waiting = []
        elif runs:
            runs[-1][2] = b
            runs[-1][3].append(bits)
        else:
            waiting.append((a, b, bits))
    if waiting:
        total = [sum(x) for x in zip(*(w for _, _, w in waiting))]
        runs = [[total.index(min(total)), waiting[0][0], waiting[-1][1], [w for _, _, w in waiting]]]
    return [(LANGS[k], a + 1, b, confidence(k, bits)) for k, a, b, bits in runs]


def confidence(k: int, bits) -> float:
    """The share of language k when every language is as likely as its code of the sentences is short."""
    total = [sum(x) for x in zip(*bits)]
    return round(1 / sum(2.0 ** -min(60.0, max(-60.0, x - total[k])) for x in total), 6)


def training_sample(df: DataFrame, text: str, label: str, per_label: int = SAMPLE) -> list[tuple[str, str]]:
    """The per_label distinct texts of each label whose hashes come first, whole and in that order, so that neither copies nor the order of rows decide. Two passes, the first over hashes only."""
    rows = df.where(F.length(text) > 0).select(label_of(F.col(label)).alias("l"), F.xxhash64(text).alias("h"), F.col(text).alias("t")).where("l is not null")
    distinct = settle(rows.select("l", "h").distinct(), "hashes")
    counts = {r["l"]: r["n"] for r in distinct.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    # a margin of hashes reaches the driver, of which the first per_label count
    place = F.pmod("h", F.lit(1 << 40))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2 * per_label + 100) / n))]), F.col("l"))
    near: dict[str, list] = {}
    for r in distinct.where(place < share * (1 << 40)).select("l", "h", place.alias("p")).collect():
        near.setdefault(r["l"], []).append((r["p"], r["h"]))
    first = {(k, h): n for k, v in near.items() for n, (_, h) in enumerate(sorted(v)[:per_label])}
    wanted = F.broadcast(df.sparkSession.createDataFrame(list(first), "l string, h bigint"))
    got = rows.join(wanted, ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t")).collect()
    return [(r["l"], r["t"]) for r in sorted(got, key=lambda r: (first[r["l"], r["h"]], r["l"]))]


def read_languages(df: DataFrame, key: str, text: str, label: str, per_label: int = SAMPLE) -> DataFrame:
    """key, label (the language named, null if none) and segments: array<struct<seg_no, lang, start_pos, end_pos, confidence>>.

    Null, empty and prose-less texts have no segments. A table without any usable label trains nothing and gives no
    segments either. Texts are read whole. Equal texts get equal results.
    """
    spark = df.sparkSession
    sample = training_sample(df, text, label, per_label)
    shared = spark.sparkContext.broadcast(train(sample).levels if sample else None)
    kind = pa.struct([("seg_no", pa.int32()), ("lang", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("confidence", pa.float64())])

    def go(batches):
        reader = Reader(shared.value) if shared.value else None
        for b in batches:
            texts = b.column(2).to_pylist()
            got = []
            for i in range(0, len(texts), 500):
                got += reader.segments(texts[i : i + 500]) if reader else [[] for _ in texts[i : i + 500]]
            flat = [(n + 1, *s) for x in got for n, s in enumerate(x)]
            parts = [pa.array([s[i] for s in flat], f.type) for i, f in enumerate(kind)]
            ends = pa.array(np.cumsum([0, *map(len, got)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, fields=list(kind)))], names=[key, "label", "segments"])

    schema = f"{key} {dict(df.dtypes)[key]}, label string, segments array<struct<seg_no:int,lang:string,start_pos:int,end_pos:int,confidence:double>>"
    return df.select(key, label_of(F.col(label)).alias("label"), text).mapInArrow(go, schema)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_languages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    case = (F.size("segments") > 1) | (F.size("segments") == 1) & (F.col("label").isNull() | (F.col("label") != F.col("segments")[0]["lang"]))
    return got.where(case).select("doc_id", F.inline("segments")).select("doc_id", "seg_no", "lang")


def main_languages(got: DataFrame) -> DataFrame:
    """What read_languages gives, summed up for each row: the language of most characters of prose, its share of them, its best confidence, and the number of segments. Rows without prose have nulls."""
    letters = lambda segments: F.aggregate(segments, F.lit(0), lambda a, s: a + s["end_pos"] - s["start_pos"] + 1)

    def summed(lang):
        own = F.filter("segments", lambda s: s["lang"] == F.lit(lang))
        return F.struct(letters(own).alias("n"), F.lit(lang).alias("lang"), F.array_max(F.transform(own, lambda s: s["confidence"])).alias("c"))

    top = F.array_max(F.array(*[summed(k) for k in LANGS]))
    there = lambda c: F.when(F.size("segments") > 0, c)
    return got.select(got.columns[0], "label", there(top["lang"]).alias("lang"), there(F.round(top["n"] / letters(F.col("segments")), 6)).alias("share"), there(top["c"]).alias("confidence"), F.size("segments").alias("n_segments"))


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """main_languages of every document."""
    return main_languages(read_languages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang"))
