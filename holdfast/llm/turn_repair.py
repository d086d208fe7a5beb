"""Repair of conversation structure by Knuth's lightest derivations.

An item (i, state) says that the first i rows are repaired and end in a state: nothing yet, after system, after user, after
assistant. An edit of the next row, or an insertion, deduces an item from another one. Its weight is (cost, audit): the costs
add, the letters of the edits join. No deduction makes a weight smaller and none changes the order of two weights: edits of the
same rows at equal cost are never the beginning of one another, since more letters would be more insertions. So items
may be taken from an agenda in order of weight, each final when first taken, until the goal is.

A long conversation is cut into blocks of rows. The lightest derivations of a block from each state are items themselves, which
compose in order; only its audit and its repaired text, which are one value, ever meet in one task, and the text as a stream.
"""
from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from holdfast.llm.row_keys import keyed
from holdfast.llm.text import SPACES
from holdfast.session import cut

#: Rows of a block; a power of two. A conversation of more rows is long.
BLOCK = 1024
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: States by (state, initial of a role), and the one role that may be put in after a state.
STEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
PUT = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
ENDS = (NOTHING, ASSISTANT)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK, DUPLICATE, CUT, SOUND = "b", "d", "t", ""
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def fault(last: str, seen: bool) -> str:
    """The first fault of a row by its last character that is no white space ('' where there is none)."""
    return BLANK if not last else DUPLICATE if seen else SOUND if last in ".!?" else CUT


def edits(initial: str, bad: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of every edit of a row."""
    yield "D", DELETE, state
    if bad not in (BLANK, DUPLICATE):
        more = TRUNCATED if bad == CUT else 0
        if (state, initial) in STEP:
            yield "K", KEEP + more, STEP[state, initial]
        yield "R", REROLE + more, STEP[state, PUT[state][0]]


def lightest(rows: list[tuple[str, str]], start: int = NOTHING, goals: tuple[int, ...] = ENDS, every: bool = False) -> dict[int, tuple[int, str]]:
    """(cost, audit) of lightest derivations of states after all rows (initial, fault), from ``start`` before them.

    Any of ``goals`` makes the goal, which then is final with the first of them; with ``every`` each is a goal of its own.
    """
    n, final, found = len(rows), set(), {}
    agenda = [(0, "", 0, start)]
    while agenda and len(found) < (len(goals) if every else 1):
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == n:
            if state in goals:
                found[state] = (cost, audit)
        else:
            for letter, more, after in edits(*rows[i], state):
                if (i + 1, after) not in final:
                    heapq.heappush(agenda, (cost + more, audit + letter, i + 1, after))
        after = STEP[state, PUT[state][0]]
        if (i, after) not in final:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", i, after))
    return found


def repaired(rows: list[tuple[str, str]], audit: str, state: int) -> Iterator[str]:
    """Lines ``role:text`` of rows (role, text) after the edits of an audit that begins in ``state``."""
    left = iter(rows)
    for letter in audit:
        role, text = (PUT[state], "") if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter == "R":
            role = PUT[state]
        state = STEP[state, role[:1]]
        yield f"{role}:{text}"


def gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def whole(rows: list[tuple[int | None, str, str]]) -> tuple:
    """Counts, cost, audit and digest of a conversation of rows (turn, role, text) in order."""
    seen, marked = set(), []
    for _, role, text in rows:
        marked.append((role[:1], fault(text.rstrip(SPACES)[-1:], (role, text) in seen)))
        seen.add((role, text))
    faults = [f for _, f in marked]
    illegal = sum((a[0], b[0]) not in LEGAL for a, b in zip(marked, marked[1:]))
    [(cost, audit)] = lightest(marked).values()
    text = "\n".join(repaired([r[1:] for r in rows], audit, NOTHING))
    return gaps([r[0] for r in rows]), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with damage by the checksum of ``conv_id:turn``; nulls read as one space. A dropped row stays, with ``copy`` null.

    ``conversation`` and ``turn`` keep their nulls. A row repeated stands twice, with copy 0 and 1.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    code = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    role, text = F.when(code == 4, "user").otherwise(shown[2]), F.when(code == 1, "").when(code == 2, F.regexp_replace(shown[3], "[.!?]", "")).otherwise(shown[3])
    copies = F.when(code == 0, F.array(F.lit(None).cast("int"))).when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("row", "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _order(digest: str = "digest") -> list[Column]:
    """The order of a conversation: by turn, nulls first; equal turns by role and digest of the text, which no two differing rows share."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col(digest), F.col("row"), F.col("copy")]


def _short(schema: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done):
            ids, values = [d[0] for d in done], list(zip(*(d[1] for d in done)))
            columns = [pa.array(v, pa.int64()) for v in values[:6]] + [pa.array(v, pa.string()) for v in values[6:]]
            return pa.RecordBatch.from_arrays([pa.array(ids, schema), *columns], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])
        rows, conv, started, done = [], None, False, []
        for b in batches:
            for c, turn, role, text, copy in zip(*(b[x].to_pylist() for x in ("conv_id", "turn", "role", "text", "copy"))):
                if started and c != conv:
                    done.append((conv, whole(rows)))
                    rows = []
                    if len(done) >= 1000:
                        yield out(done)
                        done = []
                conv, started = c, True
                if copy is not None:
                    rows.append((turn, role, text))
        if started:
            done.append((conv, whole(rows)))
        if done:
            yield out(done)
    return run


def _spans(frame: pd.DataFrame) -> pd.DataFrame:
    """Lightest derivations through a block from and to every state, and what its neighbours must know."""
    frame = frame.sort_values("pos")
    rows = list(zip(frame["initial"], (fault(x, s) for x, s in zip(frame["last"], frame["seen"]))))
    faults = [f for _, f in rows]
    spans = [[start, end, cost, audit] for start in range(4) for end, (cost, audit) in lightest(rows, start, tuple(range(4)), True).items()]
    inside = sum((a[0], b[0]) not in LEGAL for a, b in zip(rows, rows[1:]))
    return pd.DataFrame([[frame["conv"].iloc[0], frame["block"].iloc[0], faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), inside, rows[0][0], rows[-1][0],
                          [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], [s[3] for s in spans]]], columns=[c.split()[0] for c in _SPAN.split(", ")])


_SPAN = "conv binary, block long, blank long, duplicate long, truncated long, illegal long, first string, last string, starts array<int>, ends array<int>, costs array<long>, audits array<string>"
_PATH = "conv binary, block long, state int, audit string, blank long, duplicate long, truncated long, illegal long, cost long"


def _compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks in order into conversations: a row per block with the part of the audit that the lightest derivation has there.

    Derivations that end in different states are held from where they part; what all share is given out.
    """
    names = [c.split()[0] for c in _PATH.split(", ")]
    conv, live, before, counts = None, {}, "", [0] * 4

    def flush(end: bool):
        """What is decided: all steps of the lightest one at the end, else the steps that all live ones share."""
        out = []
        if end:
            cost, steps = min(((c, s) for q, (c, s) in live.items() if q in ENDS), key=lambda x: (x[0], "".join(t[2] for t in x[1])))
            out = [[conv, *t, *([0] * 5)] for t in steps]
            out[-1][4:] = [*counts, cost]
        else:
            shared = 0
            some = [s for _, s in live.values()]
            while all(len(s) > shared + 1 for s in some) and len({s[shared] for s in some}) == 1:  # the last one stays for the end
                shared += 1
            out = [[conv, *t, *([0] * 5)] for t in some[0][:shared]]
            for q, (c, s) in live.items():
                live[q] = (c, s[shared:])
        return pd.DataFrame(out, columns=names)

    for frame in frames:
        for r in frame.itertuples(index=False):
            if r.conv != conv:
                if conv is not None:
                    yield flush(True)
                conv, live, before, counts = r.conv, {NOTHING: (0, [])}, None, [0] * 4
            best: dict[int, tuple[int, list]] = {}
            for start, end, cost, audit in zip(r.starts, r.ends, r.costs, r.audits):
                if start in live:
                    new = (live[start][0] + int(cost), [*live[start][1], (r.block, int(start), audit)])
                    old = best.get(int(end))
                    if old is None or (new[0], "".join(t[2] for t in new[1])) < (old[0], "".join(t[2] for t in old[1])):
                        best[int(end)] = new
            live = best
            counts = [a + int(b) for a, b in zip(counts, (r.blank, r.duplicate, r.truncated, r.illegal + (before is not None and (before, r.first) not in LEGAL)))]
            before = r.last
            yield flush(False)
    if conv is not None:
        yield flush(True)


def _lines(rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
    """The repaired text of a block."""
    rows = rows.sort_values("pos")
    text = "\n".join(repaired(list(zip(rows["role"], rows["text"])), path["audit"].iloc[0], int(path["state"].iloc[0]))) if len(path) else ""
    return pd.DataFrame([[path["conv"].iloc[0], path["block"].iloc[0], text]] if text else [], columns=["conv", "block", "text"])


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, h = None, None
    for frame in frames:
        for c, text in zip(frame["conv"], frame["text"]):
            if c != conv:
                if conv is not None:
                    yield pd.DataFrame([[conv, h.hexdigest()]], columns=["conv", "repaired_sha256"])
                conv, h = c, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(text.encode())
    if conv is not None:
        yield pd.DataFrame([[conv, h.hexdigest()]], columns=["conv", "repaired_sha256"])


def _conv() -> Column:
    """A key of a conversation that is never null and never another's."""
    return F.when(F.col("conv_id").isNull(), F.lit(b"")).otherwise(F.concat(F.lit(b"c"), F.col("conv_id").cast("string").cast("binary")))


def _long(rows: DataFrame, block: int) -> DataFrame:
    """Results of long conversations (conv, conv_id, turn, role, text, digest, row, copy), dealt out by blocks of rows."""
    shift = block.bit_length() - 1
    turn = F.when(F.col("copy").isNotNull(), F.col("turn"))
    every = rows.groupBy("conv", "conv_id").agg(F.max(turn).alias("high"), F.min(turn).alias("low"), F.count_distinct(turn).alias("turns"))
    rows = rows.where("copy IS NOT NULL").drop("conv_id")
    rows = rows.repartitionByRange("conv", *_order()).sortWithinPartitions("conv", *_order())
    rows = cut(rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("block", F.shiftright("pos", shift)), "turns-placed")
    # Positions grow in the order of a conversation, so the first of equal rows is the one with the smallest.
    first = rows.groupBy("conv", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    end = F.rtrim("text", F.lit(SPACES))
    narrow = rows.select("conv", "block", "pos", "role", "digest", F.left("role", F.lit(1)).alias("initial"), F.right(end, F.lit(1)).alias("last"))
    narrow = narrow.join(first, ["conv", "role", "digest"], "left").select("conv", "block", "pos", "initial", "last", F.coalesce(F.col("pos") > F.col("first"), F.lit(False)).alias("seen"))
    spans = cut(narrow.groupBy("conv", "block").applyInPandas(_spans, _SPAN), "turns-spans")
    path = cut(spans.repartition("conv").sortWithinPartitions("conv", "block").mapInPandas(_compose, _PATH), "turns-path")
    lines = rows.groupBy("conv", "block").cogroup(path.groupBy("conv", "block")).applyInPandas(_lines, "conv binary, block long, text string")
    texts = lines.repartition("conv").sortWithinPartitions("conv", "block").mapInPandas(_digests, "conv binary, repaired_sha256 string")
    audits = path.groupBy("conv").agg(*(F.sum(c).alias(c) for c in _COUNTS[1:]), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    out = every.join(audits, "conv", "left").join(texts, "conv", "left")
    gaps_ = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return out.select("conv_id", gaps_.alias("gaps"), *(F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS[1:]), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    rows: conv_id, turn, role, text (not null), row (unique), copy (null for a row that isn't there, but whose conversation is
    reported). Conversations of at most ``block`` rows are repaired where they meet, longer ones block by block, with the same results.
    """
    if block & (block - 1):
        raise ValueError("a block has a power of two rows")
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("conv", _conv())
    long = cut(rows.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > block).select("conv"), "turns-long")
    short = rows.join(long, "conv", "left_anti").repartition("conv").sortWithinPartitions("conv", *_order())
    kind = rows.schema["conv_id"].dataType
    schema = "conv_id " + kind.simpleString() + "".join(f", {c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    out = short.select("conv_id", "turn", "role", "text", "copy").mapInArrow(_short(to_arrow_type(kind)), schema)
    return out.unionByName(_long(rows.join(long, "conv", "left_semi"), block))


def repaired_conversations(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The damage of ``damaged`` and its repair, a row per original conv_id; a null conv_id is a conversation too.

    Null texts, roles, turns and ids read as one space in the damage; a null turn sorts first. Rows of equal turn follow one another
    by role, then SHA-256 of the text. Repeated rows are duplicates like any others. A conversation that lost all rows has zeros, an
    empty audit and the digest of nothing; an empty table gives no rows; other columns are ignored.
    """
    rows, key = keyed(conversations)
    return repair(damaged(rows.select(F.col(key).alias("row"), "conv_id", "turn", "role", "text")), block)
