"""Personal items in free text, found by labelers that vote and a classifier trained on what their votes agree on.

Patterns and word lists propose spans; regex, gazetteer, context and shape labelers vote yes, no or nothing on each.
Spans with equal kind, form and votes share one row of a small table (bounded by the labelers, not by the corpus),
counted over all texts. Expectation-maximisation over that table estimates how reliable each labeler is and a
posterior for each row; a logistic classifier over votes and forms, trained on those posteriors, has the last word.
The gazetteer of names is learned from the roster: whole names, and name stems and endings that combine freely in it,
so that persons who aren't listed are known by their parts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.session import settle, table

KINDS = ("email", "phone", "id_number", "address", "name")
SPANS = "tbl string, row_id bigint, field string, kind string, start_pos int, end_pos int, form string, votes string"

AT = r"(?:@|%40|\s@\s|\s?\[at\]\s?|\s?\(at\)\s?)"
DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)"
LOCAL = r"[^\W_](?:[\w.+\-]*[\w+\-])?"
LABEL = r"[^\W_](?:[\w\-]*[^\W_])?"
PATTERNS = {
    "email": [("email", re.compile(rf"(?<![\w.+/@\-])({LOCAL}){AT}({LABEL}(?:{DOT}{LABEL})+)(?![\w@])"))],
    "id_number": [
        ("ssn", re.compile(r"(?<![\w.\-])\d{3}([- ])\d{2}\1\d{4}(?![\w]|[-.]\d)")),
        ("nino", re.compile(r"(?<!\w)[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)")),
        ("tax", re.compile(r"(?<![\w+.\-])\d{2} \d{3} \d{3} \d{3}(?![\w]| ?\d)")),
        ("dni", re.compile(r"(?<!\w)\d{8}-?[A-Z](?!\w)")),
        ("card", re.compile(r"(?<![\w\-])[A-Z]\d{8}(?!\w)")),
    ],
    "phone": [
        ("plus", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}(?!\w)")),
        ("bracket", re.compile(r"(?<![\w)])\(\d{2,5}\) ?\d{3,4}[- ]?\d{3,5}(?!\w)")),
        ("dashed", re.compile(r"(?<![\w.\-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w]|[-.]\d)")),
        ("zero", re.compile(r"(?<![\w+.\-])0\d{3,4}[ /\-]\d{3}[ \-]\d{3}(?!\w)")),
        ("pairs", re.compile(r"(?<![\w+.\-])0\d(?:[ .]\d{2}){4}(?![\w]|[ .]\d)")),
    ],
}
# Kinds of streets in several languages.
_ENGLISH = r"(?:Street|Str|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Close|Crescent|Court|Ct|Place|Pl|Square|Sq|Terrace|Way|Walk|Row|Hill|Gardens|Grove|Mews|Parade|Boulevard|Blvd)"
_CITY = r"[A-ZÀ-Þ][\w'’\-]+(?: [A-ZÀ-Þ][\w'’\-]+)?"
_FLAT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room|Wohnung|Apto|Piso)\.? ?#?\w{1,5},? )?"
PATTERNS["address"] = [
    ("english", re.compile(rf"(?<![\w.])({_FLAT}\d{{1,5}}[A-Za-z]?,? (?:[A-ZÀ-Þ][\w'’\-]+ ){{1,3}}{_ENGLISH}\.?)(?=,? ?{_CITY}|\n|$)(?:, {_CITY}(?: \d{{3,6}})?)?")),
    ("german", re.compile(rf"(?<![\w.\-])({_FLAT}(?:[A-ZÀ-Þ][\w\-]{{0,40}}(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer|graben|steig)|(?:[A-ZÀ-Þ][\w\-]{{1,40}} )(?:Straße|Weg|Platz|Gasse|Allee|Ring)) \d{{1,4}} ?[a-z]?)(?![\w])(?:, (?:\d{{4,5}} )?{_CITY})?")),
    ("latin", re.compile(rf"(?<![\w.])({_FLAT}(?:Rua|Calle|Avenida|Av\.|Plaza|Praça|Paseo|Camino|Travessa|Largo|Carrer|Ronda|Estrada|Via|Piazza) (?:d[aeo]s?l? |del |de la |de las |de los )?[A-ZÀ-Þ][\w'’\-]+(?: (?:[A-ZÀ-Þ][\w'’\-]+|d[aeo]s?))*,? \d{{1,5}}\w?)(?!\w)(?:, {_CITY})?")),
    ("french", re.compile(rf"(?<![\w.])({_FLAT}\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|av\.|boulevard|bd|place|quai|chemin|impasse|allée|cours|passage|route|square) (?:de |du |des |de la |d['’]|de l['’])?(?:la |l['’])?[A-ZÀ-Þ][\w'’\-]+(?: [A-ZÀ-Þ][\w'’\-]+)*)(?:, (?:\d{{5}} )?{_CITY})?")),
]

# Words around items, in lower case. The text before a span ends with one of the first, or what follows begins with one of the second; the third tell against it.
CUES = {
    "email": (r"(?:mailto:|<|to[:= ]|from |address is |adresse est |an |a |user=|contact \(|owner\": \"|\| |;|e-?mail[: ]+|por |write to |send )$", r"^(?:>|;|&|\"|\)| when| cannot| \||,? danke| si besoin| cuando| to | or call| wrote|, in case)", r"(?:@types/|remote is |pinned |decorator |version |npm |git clone |ssh://)$"),
    "phone": (r"(?:phone[\"=: ]+|tel[.: ]+|call |call me on |reach the desk at |number is |número é |anschluss: |mobile |or |phone=\"|/ |;|, '|handy[: ]+|tél[.: ]+|fax[: ]+|\n)$", r"^(?: if the| or |, whichever|, mornings|, liga|\"| ext\.?| x\d| is also|;|'\))", r"(?:build |ticket |version |checksum is |order no\. |row id is |rfc |port |qx-|trace |code=|id=|sha |hash )$"),
    "id_number": (r"(?:id[=:( ]+|\(id |ssn[\": ]+|dni |passport no\. |tax_id\": \"|national id: |ausweisnummer |identity number \(|redact |nif |nino |steuer-?id |personalausweis |;|number )$", r"^(?: shows up|\"| must not|\) (?:into|appears)| steht| in (?:clear|log)|\))", r"(?:build |ticket |version |checksum is |order no\. |row id is |rfc |port |qx-|trace |code=|commit |sha |hash |rev )$"),
    "address": (r"(?:address[: ]+|lieferadresse ist |device to |moved to |vive en |delivery to |seed row says |, |wohnt in |habite au |mora na |\n)$", r"^(?:;? is that| desde| last month|, sent|\.|$|\n)", r"(?:chapter |block |section |page |step |line |version )$"),
    "name": (r"(?:hi, this is |hello |ask |talked to |fala com |prévenir |@author |cc:? |name:? |name\": \"|reviewed-by: |signed-off-by: |author: |author=\"|assignee = \"|opened by |frau |herr |dr\.? |mr\.? |mrs\.? |ms\.? |todo\(|it is |customer row: |patient |letter to |page of |notes: |\| |7, '|dear |regards,\n|call |import for |\n|señora? |sra?\. |von |by |-- \n)$", r"^(?:'s |’s | about the| this morning|, thanks| sobre o| avant midi| signed the| hat den| who owns| \(id |\): ask| <|;|\",? |', '| \||, not by| / |, (?:\d|flat|apt|rua|calle))", r"(?:\bthe |`|/|\\|_|@|#|\$)$"),
}
CUES = {k: (re.compile(a[:-1] + r"\Z"), re.compile(b), re.compile(c[:-1] + r"\Z")) for k, (a, b, c) in CUES.items()}
#: What follows names of products and places.
PRODUCT = re.compile(r"(?: [A-Z][\w\-]+)? (?:owns that|upgrade|channel|view is|import\.|release|module|service|parser|gateway|queue|cache|store|index|sync|mode|runner|metrics|api|sdk|library|framework|board)\b")
TAIL = re.compile(r" [^\W\d_]\.(?![^\W\d_])")
REMOTE = re.compile(r":[\w.~\-]*/")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?(?:-[^\W\d_]+(?:['’][^\W\d_]+)?)*")
PARTICLES = ("van der ", "van den ", "von der ", "de la ", "van ", "von ", "de ", "da ", "do ", "dos ", "del ", "di ", "du ", "der ", "ten ")


def _branching(names: set[str], least: int) -> tuple[set[str], set[str]]:
    """Stems and endings that combine freely: each has several partners, and different letters meet it at the seam."""
    after, before = defaultdict(set), defaultdict(set)
    for n in names:
        for i in range(2, len(n) - 1):
            after[n[:i]].add(n[i:])
            before[n[i:]].add(n[:i])
    stems = {p for p, s in after.items() if len(s) >= least and len({x[0] for x in s}) >= 3}
    ends = {s for s, p in before.items() if len(p) >= least and len({x[-1] for x in p}) >= 3}
    return stems, ends


class Gazetteer:
    """Given and family names: listed ones (2), and ones made of listed stems and endings (1)."""

    def __init__(self, people: list[tuple[str | None, str | None]]):
        self.given = {g.lower() for g, _ in people if g}
        self.family = {re.sub(r"^o['’]", "", w) for _, f in people if f for w in re.split(r"[\s\-]+", f.lower()) if len(w) > 3}
        self.short = {f.lower() for _, f in people if f and len(f) <= 3}
        self.parts = [(*_branching(names, 4), least) for names, least in ((self.given, 2), (self.family, 3))]
        self.reach = [(max(map(len, stems), default=0), max(map(len, ends), default=0)) for stems, ends, _ in self.parts]
        self.known: dict[str, tuple[int, int]] = {}

    def _made(self, w: str, which: int) -> bool:
        """Whether a stem and an ending make the word. Only seams that the longest of both can reach are tried, so a word of any length costs the same."""
        (stems, ends, least), (stem, end) = self.parts[which], self.reach[which]
        return any(w[:i] in stems and w[i:] in ends and len(w) - i >= least for i in range(max(2, len(w) - end), min(len(w) - 2, stem) + 1))

    def look(self, word: str) -> tuple[int, int]:
        """(given, family) strength of a word, 0 for neither."""
        got = self.known.get(word)
        if got is None:
            w = word.lower()
            w = w[:-2] if w.endswith(("'s", "’s")) else w
            if len(w) <= 3:
                # too short for a stem and an ending; only what the roster lists
                return (2 if w in self.given else 0), (2 if w in self.short else 0)
            given = 2 if w in self.given else int(self._made(w, 0))
            pieces = [re.sub(r"^o['’]", "", p) for p in w.split("-")]
            family = min((2 if p in self.family else int(self._made(p, 1)) for p in pieces), default=0)
            got = self.known[word] = (given, family)
            if len(self.known) > 500_000:
                self.known = {}
        return got


def _initial_before(text: str, i: int) -> int | None:
    """Start of an initial such as "T. " right before i."""
    if i >= 3 and text[i - 1] == " " and text[i - 2] == "." and text[i - 3].isupper() and (i == 3 or not (text[i - 4].isalnum() or text[i - 4] in "._-")):
        return i - 3
    return None


def name_spans(text: str, gazetteer: Gazetteer) -> list[tuple[int, int, str, int]]:
    """(start, end, form, strength) of runs of name words; form by its parts: g given, f family, i initial, c comma."""
    hits = []
    for m in WORD.finditer(text):
        w = m.group()
        # of words of three letters or less only capitals can be names
        if len(w) > 3 or w[0].isupper():
            got = gazetteer.look(w)
            if got != (0, 0):
                hits.append((m.start(), m.end(), got, w))
    out, n = [], 0
    while n < len(hits):
        start, end, (g, f), w = hits[n]
        if start and (text[start - 1] in "_@/\\$.#" or text[start - 1].isdigit()):
            n += 1
            continue
        kind = "g" if g >= f and g else "f"
        form, strength, first, lower = kind, max(g, f), start, w.islower()
        if kind == "f":
            for p in PARTICLES:
                if text[max(0, start - len(p)) : start].lower() == p and (start == len(p) or not text[start - len(p) - 1].isalnum()):
                    first = start - len(p)
                    break
        i = _initial_before(text, first)
        if i is not None:
            first, form = i, "i" + form
        while n + 1 < len(hits):
            s2, e2, (g2, f2), w2 = hits[n + 1]
            gap = text[end:s2]
            if text[end - 2 : end] in ("'s", "’s"):
                break
            if gap == " " or re.fullmatch(r" [^\W\d_]\. (?:van |von |de |da |del )?", gap) or gap.lower() in tuple(" " + p for p in PARTICLES):
                form += ("i" if "." in gap else "") + ("f" if f2 and (len(gap) > 1 and "." not in gap or not g2 or g2 < f2 or form.endswith("g") and f2) else "g")
            elif gap == ", " and set(form) == {"f"} and g2 and (g2 >= f2 or not f2):
                form += "cg"
            else:
                break
            strength, end, n = min(strength, max(g2, f2)), e2, n + 1
        tail = TAIL.match(text, end)
        if tail and form.endswith("g") and text[end + 1].isupper():
            end, form = end + 3, form + "i"
        if text[end - 2 : end] in ("'s", "’s"):
            end -= 2
        if not lower or len(form) > 1 or CUES["name"][0].search(text[max(0, first - 20) : first].lower()):
            out.append((first, end, form, strength))
        n += 1
    return out


def _cue(kind: str, text: str, a: int, b: int) -> int:
    before, after = text[max(0, a - 24) : a].lower(), text[b : b + 24].lower()
    left, right, against = CUES[kind]
    if against.search(before):
        return -1
    return int(bool(left.search(before))) or int(bool(right.search(after)))


def find_spans(text: str, gazetteer: Gazetteer) -> list[tuple[str, int, int, str, tuple[int, ...]]]:
    """(kind, start, end, form, votes) of the candidates of a text. Overlaps go to the kind listed first, then to the earlier span. Votes: pattern, word list, context, shape."""
    out, taken = [], []  # taken: spans in order, none of them over another

    def free(a, b):
        i = bisect_left(taken, (a, a))
        return (i == len(taken) or taken[i][0] >= b) and (i == 0 or taken[i - 1][1] <= a)

    def take(a, b):
        insort(taken, (a, b))

    has_at = "@" in text or "%40" in text or "[at]" in text or "(at)" in text
    has_digit = any(c in text for c in "0123456789")
    if has_at:
        for form, p in PATTERNS["email"]:
            for m in p.finditer(text):
                a, b = m.span()
                domain, local = m.group(2), m.group(1)
                real = not re.search(r"(?:^|\.)[\d.]+$", domain) and re.search(r"[^\W\d_]{2,}$", domain) is not None
                scp = REMOTE.match(text, b) is not None
                words = re.findall(r"[^\W\d_]+", local)
                listed = any(max(gazetteer.look(w)) for w in words) or any(max(gazetteer.look(w[1:])) for w in words if len(w) > 4)
                shape = -1 if scp or local.lower() in ("git", "svn", "hg", "root", "npm", "noreply", "no-reply") else 1
                plain = re.search(r"\S@\S", m.group()) is not None
                out.append(("email", a, b, "plain" if plain else "spelt", (1 if real else -1, 1 if listed else 0, _cue("email", text, a, b), shape)))
                take(a, b)
    if has_digit:
        for kind in ("id_number", "phone"):
            for form, p in PATTERNS[kind]:
                for m in p.finditer(text):
                    a, b = m.span()
                    if free(a, b):
                        digits = sum(c.isdigit() for c in m.group())
                        near = text[max(0, a - 1) : a] + text[b : b + 1]
                        shape = 1 if kind == "id_number" or 9 <= digits <= 15 else -1
                        out.append((kind, a, b, form, (1, 0, _cue(kind, text, a, b), -1 if re.search(r"[\w:#=]", near.replace("=", "")) and near[:1] != ":" else shape)))
                        take(a, b)
        for form, p in PATTERNS["address"]:
            for m in p.finditer(text):
                a, b = m.span()
                if free(a, b):
                    place = b > m.end(1)
                    out.append(("address", a, b, form, (1, 1 if place else 0, _cue("address", text, a, b), 0)))
                    take(a, b)
    for a, b, form, strength in name_spans(text, gazetteer):
        if free(a, b):
            product = PRODUCT.match(text, b) is not None
            word = text[a:b]
            shape = 1 if len(form) > 1 else 0
            out.append(("name", a, b, form if len(form) < 5 else "long", (-1 if product else 1 if not word.islower() else 0, strength, _cue("name", text, a, b), shape)))
            take(a, b)
    return out


def reliabilities(counts: list[tuple[str, str, tuple[int, ...], int]], rounds: int = 40) -> dict:
    """Posterior of each (kind, form, votes) by expectation-maximisation: true or not, labelers independent given that."""
    post = {}
    for kind in KINDS:
        rows = [(f, v, n) for k, f, v, n in counts if k == kind]
        if not rows:
            continue
        p = np.array([1 / (1 + math.exp(-(1.5 * sum(max(-1, min(1, x)) for x in v) + 0.5 - 4 * v.count(-1)))) for _, v, _ in rows])
        n = np.array([r[2] for r in rows], float)
        votes = [[r[1][j] for r in rows] for j in range(len(rows[0][1]))]
        for _ in range(rounds):
            prior = ((p * n).sum() + 1) / (n.sum() + 2)
            score = np.full(len(rows), math.log(prior / (1 - prior)))
            for column in votes:
                values = sorted(set(column))
                which = np.array([values.index(x) for x in column])
                yes = np.bincount(which, p * n, len(values)) + [0.5 if v >= 0 else 0.05 for v in values]
                no = np.bincount(which, (1 - p) * n, len(values)) + [0.5 if v <= 0 else 0.05 for v in values]
                # a labeler that says no is never taken for one that says yes, and one that says nothing counts for neither
                ratio = np.log(yes / yes.sum()) - np.log(no / no.sum())
                ratio = np.where(np.array(values) < 0, np.minimum(ratio, -2.5), np.where(np.array(values) == 0, 0.0, ratio))
                score = score + ratio[which]
            new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            if np.abs(new - p).max() < 1e-9:
                break
            p = new
        post |= {(kind, f, v): float(x) for (f, v, _), x in zip(rows, p)}
    return post


def features(kind: str, form: str, votes: tuple[int, ...]) -> list[str]:
    return ["1", f"form={form}", *[f"v{i}={v}" for i, v in enumerate(votes)], f"context={votes[2]},shape={votes[3]}"]


def train_classifier(counts, post, steps: int = 400) -> dict:
    """(kind, form, votes) -> bool by a logistic classifier for each kind, trained on the posteriors, each weighed by the logarithm of its count."""
    out = {}
    for kind in KINDS:
        rows = [(f, v, n) for k, f, v, n in counts if k == kind]
        if not rows:
            continue
        names = sorted({x for f, v, _ in rows for x in features(kind, f, v)})
        x = np.array([[name in got for name in names] for got in (set(features(kind, f, v)) for f, v, _ in rows)], float)
        y = np.array([post[kind, f, v] for f, v, _ in rows])
        w = np.log1p([n for _, _, n in rows])
        beta = np.zeros(len(names))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            beta += 0.5 * (x.T @ (w * (y - p)) / w.sum() - 0.001 * beta)
        out |= {(kind, f, v): bool(z > 0) for (f, v, _), z in zip(rows, x @ beta)}
    return out


def candidate_spans(texts: DataFrame, people: list[tuple]) -> DataFrame:
    """SPANS of all candidates in texts (tbl, row_id, field, text); positions by code points from 1, end included."""
    shared = texts.sparkSession.sparkContext.broadcast(people)

    def go(batches):
        gazetteer = Gazetteer(shared.value)
        for b in batches:
            out = []
            for t, i, f, text in zip(*(c.to_pylist() for c in b.columns)):
                if text:
                    for k, a, z, form, votes in find_spans(text, gazetteer):
                        out.append((t, i, f, k, a + 1, z, form, ",".join(map(str, votes))))
            cols = list(zip(*out)) if out else [()] * 8
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=[x.split()[0] for x in SPANS.split(", ")])

    return texts.select("tbl", "row_id", "field", "text").mapInArrow(go, SPANS)


def personal_items(texts: DataFrame, roster: DataFrame) -> DataFrame:
    """tbl, row_id, field, kind, start_pos, end_pos of the personal items in texts (tbl, row_id, field, text).

    Null and empty texts have none; texts are read whole; repeated rows repeat their items. roster (given_name,
    family_name) is the fixed list of 400 (TESTDATA.md) and may be empty: then names go unseen, the rest doesn't.
    """
    spark = texts.sparkSession
    people = [(r["given_name"], r["family_name"]) for r in roster.select("given_name", "family_name").collect()]
    spans = settle(candidate_spans(texts, people), "spans")
    counts = [(r["kind"], r["form"], tuple(map(int, r["votes"].split(","))), r["n"]) for r in spans.groupBy("kind", "form", "votes").agg(F.count("*").alias("n")).collect()]
    verdict = train_classifier(counts, reliabilities(counts))
    good = [(k, f, ",".join(map(str, v))) for (k, f, v), yes in verdict.items() if yes]
    table_ = spark.createDataFrame(good, "kind string, form string, votes string")
    # one row for each combination of form and votes: bounded by the labelers
    return spans.join(F.broadcast(table_), ["kind", "form", "votes"], "left_semi").select("tbl", "row_id", "field", "kind", "start_pos", "end_pos")


def archive_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages").select(F.lit("messages").alias("tbl"), F.col("msg_id").alias("row_id"), F.lit("content").alias("field"), F.col("content").alias("text"))
    s = table(spark, sf_dir, "sessions").select(F.lit("sessions").alias("tbl"), F.col("session_row_id").alias("row_id"), F.lit("title").alias("field"), F.col("title").alias("text"))
    return m.unionByName(s)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_items(archive_texts(spark, sf_dir), table(spark, sf_dir, "roster")).select("tbl", "row_id", "field", "kind", "start_pos")


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}


def redact(texts: DataFrame, items: DataFrame) -> DataFrame:
    """texts with a typed placeholder for each item and the rest unchanged. Items of a text meet in one row, texts don't."""
    mark = F.element_at(F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv]), F.col("kind"))
    cuts = items.groupBy("tbl", "row_id", "field").agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos", mark.alias("mark")))).alias("cuts"))
    got = texts.join(cuts, ["tbl", "row_id", "field"], "left")
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))
    step = lambda a, c: F.struct(F.concat(a["text"], F.substring(F.col("text"), a["at"], c["start_pos"] - a["at"]), c["mark"]).alias("text"), (c["end_pos"] + 1).alias("at"))
    done = F.aggregate("cuts", start, step, lambda a: F.concat(a["text"], F.substring(F.col("text"), a["at"], F.length("text"))))
    return got.select("tbl", "row_id", "field", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(done).alias("text"), F.coalesce(F.size("cuts"), F.lit(0)).alias("n_items"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = archive_texts(spark, sf_dir)
    return redact(texts, personal_items(texts, table(spark, sf_dir, "roster")))
