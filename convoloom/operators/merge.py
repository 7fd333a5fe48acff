"""Two recordings of one conversation, aligned in order and merged.

Messages of equal meaning are paired along a longest common subsequence, gaps between pairs are matched by
compatibility, and what is left stays, the composer's before the store's. Over DataFrames only hashes and classes of
messages go through Python, never their texts: merged_messages joins those by the aligned ids.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.functions import text
from convoloom.functions.bubbles import tool_text
from convoloom.functions.canonical import canonical_json
from convoloom.operators.export import ATTACHMENT, without_attachments
from convoloom.operators.messages import messages
from convoloom.operators.replicas import instances
from convoloom.operators.timeline import timed_messages
from convoloom.session import table

#: Pairs of equal keys up to which an alignment keeps thresholds; above, and above eight for each key, it keeps bits. Both give the same pairs.
LARGE = 5_000_000
#: Bytes of masks kept at once by lcs_pairs.
MASKS = 1 << 26
#: Columns that are made at once when a halving ends.
RUN = 16


def rising_columns(low: int, high: int, behind: int, before: Callable[[int, int], int]) -> Iterator[int]:
    """Columns low to high - 1 in rising order, though before(column, j) only leads from column j + 1 to j. behind is column high. The range is halved: the far half is passed through once to reach the near one, and made anew later, so one column for each halving is kept."""
    if high - low <= RUN:
        run = []
        for j in reversed(range(low, high)):
            behind = before(behind, j)
            run.append(behind)
        yield from reversed(run)
        return
    middle = (low + high) // 2
    column = behind
    for j in reversed(range(middle, high)):
        column = before(column, j)
    yield from rising_columns(low, middle, column, before)
    yield from rising_columns(middle, high, behind, before)


def lcs_pairs(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence. Equal heads always pair; of equal prospects the head of a is skipped.

    A column of suffix lengths is held as the bits of its steps along a, so a column takes a few operations on one long
    number. Memory is len(a) times the logarithm of len(b), in bits.
    """
    shared = set(b)
    at = [i for i, k in enumerate(a) if k in shared]  # what b lacks is skipped at once
    x = [a[i] for i in at]
    n, width = len(x), (len(x) + 7) // 8
    if not n:
        return []
    places = defaultdict(list)
    for i, k in enumerate(x):
        places[k].append(n - 1 - i)

    @lru_cache(max(16, MASKS // width))
    def mask(k) -> int:
        bits = bytearray(width)
        for p in places[k]:
            bits[p >> 3] |= 1 << (p & 7)
        return int.from_bytes(bits, "little")

    full = (1 << n) - 1

    def before(column: int, j: int) -> int:
        """A bit is 0 where the length grows by one."""
        if b[j] not in places:
            return column
        hit = column & mask(b[j])
        return ((column + hit) | (column - hit)) & full

    out, i, left = [], 0, None
    for j, column in enumerate(rising_columns(0, len(b), full, before)):
        left = n - column.bit_count() if left is None else left
        if not left:
            break
        bits = column.to_bytes(width, "little")
        while x[i] != b[j] and bits[(n - 1 - i) >> 3] >> ((n - 1 - i) & 7) & 1:
            i += 1
        if x[i] == b[j]:
            out.append((at[i], j))
            i, left = i + 1, left - 1
    return out


def threshold_pairs(a: Sequence, b: Sequence, where: dict) -> list[tuple[int, int]]:
    """The pairs of lcs_pairs, in time and memory that grow with the pairs of equal keys. where: the places of each key in a and in b.

    For each length the last place of a from which it is still reached, as b grows from its end; the path reads the
    changes of these places backwards.
    """
    last: list[int] = []  # negative, so that they rise
    changes: list[tuple[list[int], list[int]]] = []
    for j in range(len(b) - 1, -1, -1):
        for i in where[b[j]][0]:
            k = bisect_left(last, -i)
            if k == len(last):
                last.append(-i)
                changes.append(([], []))
            elif last[k] == -i:
                continue
            else:
                last[k] = -i
            changes[k][0].append(j)
            changes[k][1].append(i)
    out, i, j = [], 0, 0
    while changes:
        since, places = changes.pop()
        while since[-1] < j:
            since.pop()
            places.pop()
        own = where[b[j]][0]
        k = bisect_left(own, i)
        if k < len(own) and own[k] <= places[-1]:
            i = own[k]
        else:
            i = places[-1]
            others = where[a[i]][1]
            j = others[bisect_left(others, j)]
        out.append((i, j))
        i, j = i + 1, j + 1
    return out


def anchored_pairs(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """lcs_pairs at every size, by thresholds where few keys are equal."""
    where: dict = {}
    for side, keys in enumerate((a, b)):
        for i, k in enumerate(keys):
            where.setdefault(k, ([], []))[side].append(i)
    few = sum(len(p) * len(q) for p, q in where.values()) <= max(LARGE, 8 * (len(a) + len(b)))
    return threshold_pairs(a, b, where) if few else lcs_pairs(a, b)


Finder = Callable[[int, int, int], int | None]


def align(a: Sequence, b: Sequence, key, finder: Finder) -> list[tuple[int | None, int | None]]:
    """The union of both sides in order: (index in a, index in b), None where a side has no part.

    key(message) gives what must be equal to pair at once, None for what pairs with nothing at once. finder(i, j, end)
    gives the first index from j on, before end, of what in b may pair with a[i] inside a gap: first come, first served.
    """
    strong = [[(n, k) for n, k in enumerate(map(key, side)) if k is not None] for side in (a, b)]
    anchors = [(strong[0][p][0], strong[1][q][0]) for p, q in anchored_pairs([k for _, k in strong[0]], [k for _, k in strong[1]])]
    pairs, start = [], (0, 0)
    for p, q in [*anchors, (len(a), len(b))]:
        j = start[1]
        for i in range(start[0], p):
            hit = finder(i, j, q) if j < q else None
            if hit is not None:
                pairs.append((i, hit))
                j = hit + 1
        pairs.append((p, q))
        start = p + 1, q + 1
    out, i, j = [], 0, 0
    for p, q in pairs:
        out += [(n, None) for n in range(i, p)] + [(None, n) for n in range(j, q)] + [(p, q)]
        i, j = p + 1, q + 1
    return out[:-1]  # the last pair is the end of both sides


# messages as dicts, with tools -------------------------------------------------------------------------------------

_SPACE = re.compile(f"[{text.SPACE}]+")
_QUERY = re.compile(rf"^[{text.SPACE}]*<user_query>[{text.SPACE}]*(.*?)[{text.SPACE}]*</user_query>[{text.SPACE}]*$", re.S | re.I)
_ATTACHED = re.compile(rf"\n?^```{ATTACHMENT}\n([A-Za-z0-9+/=]+)\n```$", re.M)


def plain(s: str | None) -> str:
    s = s or ""
    m = _QUERY.match(s)
    return _SPACE.sub(" ", m.group(1) if m else s).strip()


def content_class(s: str | None) -> str:
    return "corrupt" if s == text.CORRUPT_MARK else "empty" if not s or s == text.EMPTY_MARK else "real"


def matched(s: str | None) -> str | tuple:
    """What of a content is compared: its text without attachments; if there is none, the attachments."""
    if not s or s == text.EMPTY_MARK:
        return ""
    return plain(_ATTACHED.sub("", s)) or tuple(_ATTACHED.findall(s)) or plain(s)


def params_text(tool: dict) -> str | None:
    return None if tool.get("params") is None else canonical_json(tool["params"])


def message_key(m: dict) -> tuple | None:
    calls = tuple((t["name"], params_text(t)) for t in m.get("tools") or [])
    return (m.get("role"), matched(m.get("content")), calls) if calls or content_class(m.get("content")) == "real" else None


def tools_conflict(a: list[dict], b: list[dict]) -> bool:
    """Whether a name both sides use has parameters on both, all different and none left open."""
    for name in {t["name"] for t in a} & {t["name"] for t in b}:
        pa_, pb = ({params_text(t) for t in side if t["name"] == name} for side in (a, b))
        if None not in pa_ and None not in pb and not pa_ & pb:
            return True
    return False


def tools_fit(a: list[dict], b: list[dict]) -> bool:
    if not a or not b:
        return True
    return any(x["name"] == y["name"] and (params_text(x) is None or params_text(y) is None or params_text(x) == params_text(y)) for x in a for y in b)


def is_tool_mark(m: dict) -> bool:
    """Whether a content is only the printed form of one of the message's own calls."""
    first = (m.get("content") or "").lstrip().split("\n", 1)[0].strip()
    return first.startswith("[Tool:") and any(first in (f"[Tool: {t['name']}]", tool_text({"name": t["name"]}).split("\n", 1)[0]) for t in m.get("tools") or [])


def messages_fit(a: dict, b: dict) -> bool:
    """Whether two messages may be the same one."""
    ta, tb = a.get("tools") or [], b.get("tools") or []
    if a.get("role") != b.get("role") or tools_conflict(ta, tb):
        return False
    ca, cb = content_class(a.get("content")), content_class(b.get("content"))
    fits = ca == cb if "corrupt" in (ca, cb) else matched(a["content"]) == matched(b["content"]) if ca == cb == "real" else True
    if fits:
        return ca == "real" or cb == "real" or tools_fit(ta, tb)
    return (is_tool_mark(a) or is_tool_mark(b)) and bool(ta) and bool(tb) and tools_fit(ta, tb)


def pair_tools(a: list[dict], b: list[dict]) -> list[tuple[int, int]]:
    """Pairs of calls of one name: those of equal ids before those of equal parameters, and these before those where a side has no parameters."""
    free, out = dict.fromkeys(range(len(b))), {}

    def pair(tag):
        """Pairs what has equal tags, in order; None is no tag."""
        waiting = defaultdict(list)
        for j in reversed(free):
            waiting[tag(b[j])].append(j)
        for i in range(len(a)):
            t = tag(a[i])
            if i not in out and t is not None and waiting[t]:
                out[i] = waiting[t].pop()
                del free[out[i]]

    pair(lambda t: (t["name"], t["id"]) if t.get("id") else None)
    pair(lambda t: (t["name"], params_text(t)) if t.get("params") is not None else None)
    for i in range(len(a)):
        if i not in out:
            open_ = a[i].get("params") is None
            hit = next((j for j in free if b[j]["name"] == a[i]["name"] and (open_ or b[j].get("params") is None)), None)
            if hit is not None:
                out[i] = hit
                del free[hit]
    return sorted(out.items())


#: What a call takes from its partner whatever their states; a result and an error only where these agree.
ALWAYS, SAME_STATE = ("files", "params"), ("result", "error")


def merge_calls(c: dict, s: dict, preferred: str) -> dict:
    main, other = (c, s) if preferred == "composer" else (s, c)
    lent = ALWAYS + (SAME_STATE if main.get("status") == other.get("status") else ())
    call = {k: other[k] for k in lent if k in other} | {k: v for k, v in main.items() if k != "id"}
    own = c.get("id") or s.get("id")
    return call | {"id": own} if own else call


def merge_tools(composer: list[dict], store: list[dict], preferred: str) -> list[dict]:
    """The composer's calls in their order, filled from their partners, then the store's that have none."""
    partner = dict(pair_tools(composer, store))
    rest = [dict(store[j]) for j in range(len(store)) if j not in set(partner.values())]
    return [merge_calls(c, store[partner[i]], preferred) if i in partner else dict(c) for i, c in enumerate(composer)] + rest


def joined_attachments(c: str | None, s: str | None, preferred: str) -> str | None:
    """One content with the attachments of both, the composer's first, each once; None if there are none or the contents don't belong together."""
    texts = {"composer": c or "", "store": s or ""}
    base = {k: _ATTACHED.sub("", v) for k, v in texts.items()}
    coded = {k: _ATTACHED.findall(v) for k, v in texts.items()}
    if not any(coded.values()):
        return None
    alike = plain(base["composer"]) and plain(base["composer"]) == plain(base["store"])
    if not alike and not set(coded["composer"]) & set(coded["store"]) and "empty" not in map(content_class, texts.values()):
        return None
    other = "store" if preferred == "composer" else "composer"
    kept = base[preferred] if plain(base[preferred]) and content_class(texts[preferred]) == "real" else base[other]
    blocks = [f"```{ATTACHMENT}\n{x}\n```" for x in dict.fromkeys(coded["composer"] + coded["store"])]
    return "\n".join([kept] * bool(kept) + blocks)


def merge_pair(c: dict, s: dict, preferred: str = "composer") -> dict:
    """One message of a composer's and a store's: the preferred side's values, filled from the other; identity and time the composer's first."""
    main, other = (c, s) if preferred == "composer" else (s, c)
    said = lambda m: {k: v for k, v in m.items() if v not in (None, [], "") and k not in ("ms", "ms_source", "tools", "content")}
    out = said(other) | said(main) | {"id": c.get("id"), "source": "both"}
    weak = content_class(main.get("content")) != "real" or is_tool_mark(main) and not is_tool_mark(other)
    content = other.get("content") if weak and content_class(other.get("content")) == "real" else main.get("content")
    out["content"] = joined_attachments(c.get("content"), s.get("content"), preferred) or content
    tools = merge_tools(c.get("tools") or [], s.get("tools") or [], preferred)
    timed = c if c.get("ms") is not None else s
    return out | ({"tools": tools} if tools else {}) | {k: timed[k] for k in ("ms", "ms_source") if timed.get(k) is not None}


def merge_conversation(composer: list[dict], store: list[dict], preferred: str = "composer") -> list[dict]:
    def finder(i, j, end):
        return next((n for n in range(j, end) if messages_fit(composer[i], store[n])), None)

    one = lambda i, j: merge_pair(composer[i], store[j], preferred) if i is not None and j is not None else composer[i] | {"source": "composer"} if i is not None else store[j] | {"source": "store"}
    return [one(i, j) for i, j in align(composer, store, message_key, finder)]


# DataFrames --------------------------------------------------------------------------------------------------------

ALIGNED = "session_id string, pos int, composer_msg bigint, store_msg bigint, source string"


def align_stacks(rows: DataFrame) -> DataFrame:
    """ALIGNED of rows (session_id, msg_id, stack, role, key bigint, class): composer and both make the one side, store and both the other, in order of msg_id.

    Rows of class empty pair with any message of their role inside a gap. A session meets in one task, by hashes only,
    and comes there as sorted rows, never as one value.
    """
    columns = ["session_id", "msg_id", "stack", "role", "key", "class"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    key = lambda x: (x[1], x[2]) if x[3] == "real" else None

    def finder_of(left, right) -> Finder:
        """By the places of each role, class and key, so a gap costs no more than its rows."""
        places = defaultdict(list)
        for n, (_, role, k, class_) in enumerate(right):
            places[role, class_].append(n)
            if class_ == "real":
                places[role, class_, k].append(n)

        def finder(i, j, end):
            _, role, k, class_ = left[i]
            wanted = {"real": ((role, "real", k), (role, "empty")), "empty": ((role, "real"), (role, "empty")), "corrupt": ((role, "corrupt"),)}[class_]
            hits = [own[at] for own in (places.get(w, ()) for w in wanted) if (at := bisect_left(own, j)) < len(own)]
            return min(hits) if hits and min(hits) < end else None

        return finder

    def sessions(batches):
        """session_id and both sides, rows of (msg_id, role, key, class)."""
        session, sides = None, ([], [])
        for b in batches:
            for s, msg, stack, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if s != session:
                    yield session, sides
                    session, sides = s, ([], [])
                for side, name in zip(sides, ("composer", "store")):
                    if stack in (name, "both"):
                        side.append((msg, *rest))
        yield session, sides

    def go(batches):
        out = [[] for _ in types]

        def taken():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[c.split()[0] for c in ALIGNED.split(", ")])
            for c in out:
                c.clear()
            return batch

        for session, sides in sessions(batches):
            for n, (i, j) in enumerate(align(*sides, key, finder_of(*sides))):
                row = (session, n + 1, sides[0][i][0] if i is not None else None, sides[1][j][0] if j is not None else None, "both" if i is not None and j is not None else "composer" if i is not None else "store")
                for c, v in zip(out, row):
                    c.append(v)
                if len(out[0]) == 10_000:
                    yield taken()
        yield taken()

    return rows.select(columns).repartition("session_id").sortWithinPartitions(columns).mapInArrow(go, ALIGNED)


def hashed_messages(m: DataFrame, key: Column) -> DataFrame:
    return m.where("stack in ('composer', 'store', 'both')").select("session_id", "msg_id", "stack", "role", F.xxhash64(key).alias("key"), text.content_class(F.col("content")).alias("class"))


def pick_scalar(preferred: Column, other: Column) -> Column:
    """The preferred text unless it is empty, else the other."""
    return F.when(F.length(preferred) > 0, preferred).otherwise(other)


def merge_summaries(composer: DataFrame, store: DataFrame) -> DataFrame:
    """Full outer merge of one row per id of each side (id, title, message_count): the composer's values first, sources in declared order."""
    c, s = composer.select("id", F.col("title").alias("ct"), F.col("message_count").alias("cn")), store.select("id", F.col("title").alias("st"), F.col("message_count").alias("sn"))
    got = c.withColumn("c", F.lit("composer")).join(s.withColumn("s", F.lit("store")), "id", "full")
    return got.select("id", pick_scalar(F.col("ct"), F.col("st")).alias("title"), F.coalesce("cn", "sn").alias("message_count"), F.concat_ws(",", "c", "s").alias("sources"))


def last_results(calls: DataFrame, results: DataFrame, call_key: str, result_key: str, order: Column, value: Column) -> tuple[DataFrame, DataFrame]:
    """(calls with the last result of their key, results without a call). Results are reduced to one row per key before they meet the calls."""
    last = results.groupBy(F.col(result_key).alias(call_key)).agg(F.count("*").alias("n_results"), F.max(F.struct(order.alias("o"), value.alias("v"))).alias("r"))
    got = calls.join(last, call_key, "left").withColumn("result", F.col("r.v")).drop("r")
    return got, results.join(calls.select(F.col(call_key).alias(result_key)), result_key, "left_anti")


def within_spans(rows: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, slack: int = 60_000) -> DataFrame:
    """rows joined to the spans of their key that hold their time; open ends hold everything, the end is loose by slack."""
    inside = (F.col(at) >= F.coalesce(start, F.lit(-(2**62)))) & (F.col(at) <= F.coalesce(F.col(end), F.lit(2**61)) + slack)
    return rows.join(spans, key).where(inside)


def q33_last_result(spark, d):
    l = table(spark, d, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"))
    got, _ = last_results(table(spark, d, "orders").select("o_orderkey"), l, "o_orderkey", "l_orderkey", order, F.col("l_partkey"))
    return got.select("o_orderkey", F.coalesce("n_results", F.lit(0)).alias("n_results"), "result")


def q34_range_join(spark, d):
    from convoloom.operators.timeline import metadata_times

    got = within_spans(timed_messages(spark, d).where("ms is not null"), metadata_times(spark, d), "session_id", "ms", "meta_created", "meta_updated")
    return got.select("session_id", "msg_id", "ms")


def first_copies(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    got = instances(spark, sf_dir).where(F.col("role") == role).groupBy("id").agg(F.min("session_row_id").alias("session_row_id"))
    return got.join(table(spark, sf_dir, "sessions").select("session_row_id", "title", "message_count"), "session_row_id").select("id", "title", "message_count")


def q35_summary_merge(spark, d):
    return merge_summaries(first_copies(spark, d, "composer"), first_copies(spark, d, "store"))


def q45_lcs_align(spark, d):
    m = messages(spark, d)
    # the key holds the row itself, so what both stacks hold is exactly what pairs
    return align_stacks(hashed_messages(m.withColumn("content", F.lit("x")), F.col("msg_id"))).where("source = 'both'").select("session_id", F.col("composer_msg").alias("msg_id"))


def match_text(content: Column) -> Column:
    """matched as a column: the text without attachments, or, if that is blank, the whole."""
    whole = F.coalesce(content, F.lit(""))
    base = text.normalize_text(text.unwrap_query(without_attachments(whole)))
    return F.when(base != "", base).otherwise(text.normalize_text(text.unwrap_query(whole)))


def merged_messages(m: DataFrame, timed: DataFrame) -> DataFrame:
    """ALIGNED with the merged message of each place: role, message_key, content, model, ms, ms_source.

    m has session_id, msg_id, stack, role, content, message_key and model; timed has msg_id, ms and source. The composer
    is the backbone: key, model and time are its own if it has them, its content gives way where it is empty or damaged
    and the store's isn't, and attachments of both stay, the composer's first. Texts are joined by id, so a session of
    any size is spread over tasks; null contents stay null, rows of other stacks or without session aren't there.
    """
    aligned = align_stacks(hashed_messages(m, match_text(F.col("content"))))
    rows = m.join(timed.select("msg_id", "ms", F.col("source").alias("ms_source")), "msg_id", "left")
    side = lambda name: rows.select(F.col("msg_id").alias(f"{name}_msg"), F.struct("role", F.when(F.col("message_key") != "", F.col("message_key")).alias("message_key"), "content", "model", "ms", "ms_source", text.content_class(F.col("content")).alias("class")).alias(name))
    got = aligned.join(side("composer"), "composer_msg", "left").join(side("store"), "store_msg", "left")
    c, s = F.col("composer"), F.col("store")
    plainly = F.when((c["class"] != "real") & (s["class"] == "real") | c.isNull(), s["content"]).otherwise(c["content"])
    coded = lambda x: F.regexp_extract_all(F.coalesce(x["content"], F.lit("")), F.lit(rf"(?m)^```{ATTACHMENT}\n([A-Za-z0-9+/=]+)\n```$"), F.lit(1))
    lost = F.filter(coded(s), lambda k: ~F.array_contains(coded(c), k))
    more = F.concat_ws("\n", without_attachments(plainly), *[F.when(F.size(x) > 0, F.array_join(F.transform(x, lambda k: F.concat(F.lit(f"```{ATTACHMENT}\n"), k, F.lit("\n```"))), "\n")) for x in (coded(c), lost)])
    content = F.when((F.col("source") == "both") & (F.size(lost) > 0), more).otherwise(plainly)
    timed_by = F.when(c["ms"].isNotNull(), c).otherwise(s)
    first = lambda f: F.coalesce(c[f], s[f]).alias(f)
    return got.select("session_id", "pos", "composer_msg", "store_msg", "source", first("role"), first("message_key"), content.alias("content"), first("model"), timed_by["ms"].alias("ms"), timed_by["ms_source"].alias("ms_source"))


def q46_merged_sessions(spark, d):
    return merged_messages(messages(spark, d), timed_messages(spark, d))
