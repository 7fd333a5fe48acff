"""Broken pairs of prompt and response, each with one type of defect.

Whether an unfinished-looking answer stops before its end is read off the corpus: its last fragment is sorted among
all finished sentences (code, numbers and white space made equal), and its neighbour tells whether it is one of them,
or a shortened version of one (a common prefix as long as itself). Lengths at which unfinished answers pile up count
as length limits. Empty answers, copies of the question, refusals and wrong languages are told by rules, the
languages by the context trees of the documents.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoloom.functions.ordered import with_next
from convoloom.llm.conversations import ASSISTANT, USER, speaker
from convoloom.llm.language import LANGS, SPELLINGS, Reader, train, training_sample
from convoloom.session import settle, table

CODE = regex.compile(r"```.*?```|`[^`\n]*`", regex.S)
ENDS = regex.compile(r"(?<=[.!?…])[\"'”’»)\]]*+\s++|(?<=[。！？])(?![。！？])[”’」』）]*+\s*+|\n++")
CLOSERS = "\"'”’»“）)]」』*_"
MARKS = regex.compile(r"^\s*(?:[>#*\-]+|\d+[.)])\s+")
LAST_MARK = regex.compile(r"\n\s*(?:[-*+•]|(\d+)[.)])\s*$")
HIDDEN = "​‌‍⁠﻿­\xa0　 \t\r\n"
HAN = regex.compile(r"\p{Han}")
WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
WRAPPED = regex.compile(r"</?[A-Za-z_]+/?>")

# Refusals, at the start of an answer. Quoted or later mentions are none.
SORRY = {
    "en": r"(?:(?:i'?m|i am|we are) (?:very |really )?(?:sorry|afraid)|sorry|unfortunately|apologies|i apologi[sz]e|regrettably)",
    "de": r"(?:(?:es )?tut mir (?:sehr )?leid|leider|entschuldigung|bedauerlicherweise)",
    "fr": r"(?:(?:je suis )?désolée?|malheureusement|je regrette|navrée?|pardon)",
    "es": r"(?:lo siento(?: mucho)?|lamentablemente|lo lamento|perdón|disculpa|desafortunadamente)",
    "pt": r"(?:lamento|infelizmente|desculpa|desculpe|sinto muito|peço desculpa)",
    "zh": r"(?:很?抱歉|很遗憾|对不起|不好意思|遗憾的是)",
}
REFUSE = {
    "en": r"(?:as an? (?:ai |language |virtual )*(?:assistant|model)[, ]+)?(?:i|we) (?:can'?t|can not|cannot|won'?t|will not|(?:am|'m|are) (?:unable|not able|not allowed|not permitted)(?: to)?|won'?t be able to|must|have to|need to)(?: be able to)? ?(?:\w+ ){0,2}?(?:help|assist|provide|answer|do (?:this|that)|comply|fulfil|support|decline|refuse|respond|discuss|share|continue)|that is something i have to decline|this falls outside what i'?m allowed|(?:this|that|your) request (?:is|has to be) (?:declined|refused)",
    "de": r"(?:aber )?(?:hier )?(?:ich )?(?:kann|darf|muss|möchte|werde) (?:ich )?(?:\w+ ){0,5}?(?:nicht (?:helfen|beantworten|weiterhelfen|antworten|unterstützen)|ablehnen|verweigern)",
    "fr": r"(?:mais )?je (?:ne (?:peux|suis|puis) pas (?:\w+ ){0,5}?(?:répondre|aider|autorisée?|en mesure|accéder)|(?:dois|préfère) (?:\w+ )?(?:refuser|décliner))|il ne m'est pas permis",
    "es": r"(?:pero )?(?:no (?:puedo|me está permitido|me es posible|estoy autorizad[oa]) (?:\w+ ){0,3}?(?:ayudar|responder|contestar|hacer|atender|continuar)|(?:tengo que|debo) (?:rechazar|negarme))",
    "pt": r"(?:mas )?(?:não (?:posso|me é permitido|consigo|estou autorizad[oa]) (?:\w+ ){0,3}?(?:ajudar|responder|fazer|continuar|atender)|(?:tenho de|tenho que|devo) (?:recusar|rejeitar))",
    "zh": r"(?:但)?我?(?:不能|无法|必须|不可以|没办法)(?:\p{Han}{0,4})?(?:回答|协助|帮助|完成|拒绝|提供|满足)",
}
REFUSAL = regex.compile("^(?:" + "|".join(rf"(?:{SORRY[k]}[,，、 ]*(?:but |aber |mais |pero |mas )?(?:hier )?)?(?:{REFUSE[k]})" for k in LANGS) + ")")
#: A refusal says little else.
REFUSAL_WORDS, REFUSAL_SIGNS = 45, 160

#: A question that asks for a language, in any of the languages: a verb or noun of answering, and a language's name behind in, auf, en, em or 用.
ASKED = regex.compile(r"(?:\b(?:answer|reply|respond|write|text|translat\w+|antwort\w*|schreib\w*|übersetz\w*|répon\w+|écri\w+|tradui\w+|respond\w+|contest\w+|escrib\w+|escrev\w+|traduz\w*|texto|texte)\b[^.?!]{0,40}?\b(?:in|auf|en|em|into|to|para|ins?)\s+|请?用|翻译成)\s*(?:the )?(" + "|".join(sorted({w for v in SPELLINGS.values() for w in v.split() if len(w) > 3 or HAN.search(w)} | {"英文", "英语", "德语", "德文", "法语", "法文", "西班牙语", "葡萄牙语", "葡语"}, key=len, reverse=True)) + r")(?!\p{Latin})")
NAMES = {w: k for k, v in SPELLINGS.items() for w in v.split()} | {"英文": "en", "英语": "en", "德语": "de", "德文": "de", "法语": "fr", "法文": "fr", "西班牙语": "es", "葡萄牙语": "pt", "葡语": "pt"}


def ends_well(s: str) -> bool:
    """Whether a text ends with a sentence's end, quotes and brackets aside."""
    return s.rstrip(CLOSERS).endswith((".", "!", "?", "。", "！", "？"))


def open_mark(text: str) -> bool:
    """Whether a text's last line is a list's mark and no more. A number must be a list's first or follow one of the list; any other is a value."""
    found = LAST_MARK.search(text)
    n = int(found[1] or 0) if found else 0
    return bool(found) and (n <= 1 or bool(regex.search(rf"^\s*0*{n - 1}[.)]\s", text, regex.M)))


def skeleton(s: str) -> str:
    """A sentence with code, numbers, marks and white space made equal, without what ends it, in lower case."""
    s = CODE.sub("`x`", MARKS.sub("", s))
    s = regex.sub(r"\d+", "9", s)
    return " ".join(s.split()).rstrip(" .!?。！？…\"'”’»“）)]」』").lower()


def variants(k: str) -> list[str]:
    """The skeleton itself and without an opening phrase up to a colon or comma."""
    out = [k]
    for sign in (": ", "：", ", ", "，"):
        head, found, tail = k.partition(sign)
        if found and len(head) < 40 and len(tail) > 8:
            out.append(tail)
    return out


def tail_of(k: str) -> str:
    """The last three words, or the last six signs where there are no spaces."""
    words = k.split(" ")
    return " ".join(words[-3:]) if len(words) > 3 else k[-6:] if HAN.search(k) else k


def parts(text: str | None) -> tuple[list[str], str | None]:
    """Skeletons of the finished sentences of a text, and that of its unfinished last fragment if prose ends it."""
    text = (text or "").strip(HIDDEN)
    pieces = [p for p in ENDS.split(text) if p and p.strip()]
    done = [skeleton(p) for p in pieces if ends_well(p.rstrip())]
    last = pieces[-1].rstrip() if pieces else ""
    open_ = bool(last) and (not ends_well(last) or open_mark(text))
    return [k for k in done if len(k) > 8], skeleton(last) if open_ else None


def nothing_said(text: str | None) -> bool:
    """No letter, digit or symbol but marks, tags and empty code."""
    return not regex.search(r"[\p{L}\p{N}\p{S}]", regex.sub(r"[`~^|<>=+$]", "", WRAPPED.sub("", regex.sub(r"```\w*\s*```", "", text or ""))))


def plain(text: str) -> str:
    return " ".join(WORDS.findall(WRAPPED.sub(" ", text).lower().replace("_", " ")))


def is_copy(question: str, answer: str) -> bool:
    """The question again and no more, but for a few words ahead of it."""
    q, a = plain(question), plain(answer)
    if not q or q not in a:
        return False
    head, *rest = a.split(q)
    return not any(r.strip() for r in rest) and (len(head.split()) <= 4 and len(head) <= 30)


def is_refusal(answer: str) -> bool:
    a = regex.sub(r"\s+", " ", answer.strip(HIDDEN).lower().replace("’", "'"))
    return bool(REFUSAL.match(a)) and len(a) <= REFUSAL_SIGNS * 2 and len(a.split()) <= REFUSAL_WORDS


def asked_language(question: str) -> str | None:
    found = ASKED.findall(question.lower())
    return NAMES.get(found[-1]) if found else None


def stops_short(answer: str, known: str | None, at_limit: bool) -> bool:
    """Whether an answer stops before its end. known: what the corpus says of its last fragment (finished, tail, shortened, unknown)."""
    text = answer.strip(HIDDEN)
    if text.count("```") % 2 or open_mark(text):
        return True
    last = text.rsplit("\n", 1)[-1].strip()
    if text.endswith("```") or ends_well(last):
        return False
    if last.count("`") % 2:
        return True
    if regex.match(r"^(?:[-*]|\d+\.)\s+`[^`]+`$", last) or regex.match(r"^Status:\s*\S", last):
        return False
    if regex.match(r"^(?:\[Tool|File:)", last):
        return True
    if len(WORDS.findall(last)) <= 1 and "\n" not in text and len(text) < 25:
        return False
    if last.endswith(("…", "...", ",", ":", ";", "，", "、")):
        return True
    return at_limit and known != "finished" or known in ("shortened", "unknown")


def view_pairs(df: DataFrame) -> DataFrame:
    """row_id, question, answer: each user's message whose next message in its view, by msg_no, then row_id, is the assistant's. Null views or numbers have no pairs."""
    rows = df.where("view_id is not null and msg_no is not null").select("view_id", "msg_no", "row_id", speaker(F.col("role")).alias("who"), "content")
    got = with_next(rows, ["view_id", "msg_no", "row_id"], ["view_id", "who", "content"], "views")
    return got.where((F.col("who") == USER) & (F.col("next.who") == ASSISTANT) & (F.col("next.view_id") == F.col("view_id"))).select("row_id", F.col("content").alias("question"), F.col("next.content").alias("answer"))


def last_fragments(pairs: DataFrame) -> DataFrame:
    """row_id and known, for answers that end in an unfinished fragment."""

    def split(batches):
        for b in batches:
            done, rows = set(), []
            for i, q, a in zip(*(c.to_pylist() for c in b.columns)):
                for text in (q, a):
                    finished, fragment = parts(text)
                    for k in finished:
                        done.update("s" + v for v in variants(k))
                        done.add("t" + tail_of(k))
                if fragment:
                    rows += [(i, "s" + v) for v in variants(fragment)] + [(i, "t" + tail_of(fragment))]
            ids = [None] * len(done) + [r[0] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([*done, *(r[1] for r in rows)], pa.string())], names=["row_id", "k"])

    keys = settle(pairs.select("row_id", "question", "answer").mapInArrow(split, "row_id bigint, k string"), "fragments")
    finished = keys.where("row_id is null").select("k").distinct()
    asked = keys.where("row_id is not null").select("k").distinct()
    # fragments and finished sentences in one order; in it, whatever a key is a prefix of follows it at once
    both = finished.withColumn("done", F.lit(1)).unionByName(asked.withColumn("done", F.lit(0))).groupBy("k").agg(F.max("done").alias("done"), F.min("done").alias("ask"))
    sorted_ = settle(both.repartitionByRange("k").sortWithinPartitions("k").select("*", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("g")), "neighbours")
    heads = sorted_.where("done = 1").groupBy("piece").agg(F.min_by("k", "g").alias("head"))
    w = Window.partitionBy("piece").orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, -1)
    near = sorted_.withColumn("after", F.last(F.when(F.col("done") == 1, F.col("k")), ignorenulls=True).over(w)).where("ask = 0")
    # one head for each piece: as many as shuffle partitions
    pieces = sorted_.select("piece").distinct().join(heads, "piece", "left")
    following = pieces.select("piece", F.last("head", ignorenulls=True).over(Window.orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    near = near.join(F.broadcast(following), "piece", "left").withColumn("after", F.coalesce("after", "later"))
    known = near.select("k", F.when(F.col("done") == 1, F.when(F.col("k").startswith("s"), 0).otherwise(1)).when(F.col("k").startswith("s") & F.col("after").startswith(F.col("k")), 2).otherwise(3).alias("n"))
    # whole sentence beats shortened sentence beats known ending
    best = keys.where("row_id is not null").join(known, "k").groupBy("row_id").agg(F.collect_set("n").alias("n"))
    return best.select("row_id", F.when(F.array_contains("n", 0), "finished").when(F.array_contains("n", 2), "shortened").when(F.array_contains("n", 1), "tail").otherwise("unknown").alias("known"))


def length_limits(pairs: DataFrame, fragments: DataFrame, least: int = 20, times: int = 6) -> DataFrame:
    """Lengths at which unfinished answers pile up: at least so many of them, and so many times the mean of the 10 lengths around. As many rows as there are lengths."""
    n = pairs.join(fragments.where("known <> 'finished'"), "row_id", "left_semi").groupBy(F.length("answer").alias("length")).count()
    w = Window.orderBy("length").rangeBetween(-5, 5)
    return n.withColumn("around", (F.sum("count").over(w) - F.col("count")) / 10).where((F.col("count") >= least) & (F.col("count") >= F.col("around") * times)).select("length")


def judge(question: str | None, answer: str | None, known: str | None, at_limit: bool, q_lang: str | None, a_lang: str | None) -> str | None:
    """The defect of one pair, or None. Of several rules the first counts: empty, copy, refusal, other_language, truncated."""
    question = question or ""
    if nothing_said(answer):
        return "empty"
    if is_copy(question, answer):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    wanted = asked_language(question) or q_lang
    if a_lang and wanted and a_lang != wanted:
        return "other_language"
    return "truncated" if stops_short(answer, known, at_limit) else None


def main_language(segments) -> str | None:
    size: dict[str, int] = {}
    for lang, a, b, _ in segments:
        size[lang] = size.get(lang, 0) + b - a + 1
    return max(size, key=size.get) if size else None


def without_quote(text: str | None) -> str | None:
    """A text without quoted lines, if anything else is left."""
    if not text:
        return text
    rest = "\n".join(x for x in WRAPPED.sub("", text).split("\n") if not x.lstrip().startswith(">"))
    return rest if rest.strip() else text


def defects(pairs: DataFrame, labelled: DataFrame, text: str, label: str) -> DataFrame:
    """row_id and defect of each defective pair of pairs (row_id, question, answer).

    labelled gives the bounded training sample of the language trees. Null answers are empty ones; null questions can't
    be copied and have no language; answers whose language can't be told (numbers, single words, code) have none wrong.
    Equal pairs are judged equally. No pairs, no rows.
    """
    spark = pairs.sparkSession
    pairs = settle(pairs, "pairs")
    sample = training_sample(labelled, text, label)
    shared = spark.sparkContext.broadcast(train(sample).levels if sample else None)
    fragments = settle(last_fragments(pairs), "known")
    limits = length_limits(pairs, fragments).withColumn("at_limit", F.lit(True))
    rows = pairs.join(fragments, "row_id", "left").join(limits, F.length("answer") == F.col("length"), "left").select("row_id", "question", "answer", "known", F.coalesce("at_limit", F.lit(False)).alias("at_limit"))

    def go(batches):
        reader = Reader(shared.value) if shared.value else None
        for b in batches:
            ids, q, a, known, limit = (c.to_pylist() for c in b.columns)
            langs = [[None] * len(ids)] * 2
            if reader:
                langs = [[main_language(s) for s in reader.segments([without_quote(x) for x in texts])] for texts in (q, a)]
            got = [(i, d) for i, d in zip(ids, map(judge, q, a, known, limit, *langs)) if d]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([d for _, d in got], pa.string())], names=["row_id", "defect"])

    return rows.mapInArrow(go, "row_id bigint, defect string")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(view_pairs(table(spark, sf_dir, "degraded_messages")), table(spark, sf_dir, "documents"), "text", "lang")
