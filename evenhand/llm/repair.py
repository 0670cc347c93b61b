"""12 Conversation structure repair over a suffix-shared automaton of role and fault signatures.

A conversation's signature has a letter a turn: role initial and fault. Equal signatures are repaired once. The signatures are read from the end in
sorted order of their reversals, so that those with a common suffix follow one another; a node of the automaton stands for a suffix, made of a letter and the node after
it, and is made once. Each node holds, for each state of the grammar ``(s?(ua)+)?``, the least cost of what follows and the
first edit of the best audit, whose rest is the best audit of the node and state to which the edit leads. Among audits of equal cost the least in
ASCII order wins; as a state's edits have different initials, the first letter decides. In a task's sorted range a node is not needed again once
the next signature has left it, so memory holds one signature's nodes, and only the suffix at which two ranges meet is computed twice.

Edits: K(eep) 0; R(erole) to user or assistant 2; D(elete) 3, the only one for blank and repeated turns; I(nsert) an empty turn 2; a truncated turn that stays 1 more.

Defined results: a conversation is the rows of one conv_id, null among them; turns go by turn, nulls first, then role, then the first 32 characters of
the text, then its digest; null role or text is one space; roles with other initials than s, u and a can't be kept; a conversation whose
turns are all gone has zeros and an empty audit; an empty table has no results; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.chat import tie
from evenhand.llm.common import skew_safe_join, written

#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn. By role initial: the next state.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENDS = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Letters: the role initial (o: any other), in capitals if the text is truncated; x: must be deleted.
LETTERS = "suaoSUAOx"
MADE = {USER: "user", ASSISTANT: "assistant"}
LONG = 256  # signatures up to this length may be broadcast when they are very frequent


def solved(letter: str, after: tuple | None) -> tuple:
    """A node: for each state (cost, edit, next node, next state) of the best audit of ``letter`` and what follows it; with no letter, of the end."""
    base: list[tuple | None] = []
    for state in range(4):
        best = None
        if after is None:
            best = (0, "", None, state) if state in ENDS else None
        else:
            options = [(DELETE + after[state][0], "D", after, state)]
            if letter != "x":
                more = TRUNCATED if letter.isupper() else 0
                to = NEXT[state].get(letter.lower())
                if to is not None:
                    options.append((KEEP + more + after[to][0], "K", after, to))
                to = next(t for r, t in NEXT[state].items() if r != "s")
                options.append((REROLE + more + after[to][0], "R", after, to))
            best = min(options, key=lambda o: (o[0], o[1]))
        base.append(best)
    node = base
    for _ in range(3):  # no audit inserts more than three turns in a row
        old = tuple(node)
        node = []
        for state in range(4):
            to = next(t for r, t in NEXT[state].items() if r != "s")
            options = [o for o in (base[state], (INSERT + old[to][0], "I", "same", to) if old[to] else None) if o]
            node.append(min(options, key=lambda o: (o[0], o[1])) if options else None)
    return tuple(node)


class Suffixes:
    """The automaton's nodes along one signature, from the end; the next signature goes on from the nodes of the common suffix."""

    def __init__(self) -> None:
        self.reversed, self.nodes, self.made = "", [solved("", None)], 0

    def audit(self, signature: str) -> tuple[int, str]:
        """Least cost and best audit of a signature."""
        back, same = signature[::-1], 0
        for a, b in zip(back, self.reversed):
            if a != b:
                break
            same += 1
        del self.nodes[same + 1 :]
        for letter in back[same:]:
            self.nodes.append(solved(letter, self.nodes[-1]))
            self.made += 1
        self.reversed = back
        node, state, edits = self.nodes[-1], START, []
        cost = node[START][0]
        while node is not None and node[state][1]:
            _, edit, after, to = node[state]
            edits.append(edit)
            node, state = node if after == "same" else after, to
        return cost, "".join(edits)


def checked(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with blank, duplicate, truncated (the first that holds) and letter, tie and number of turns before of equal role and text."""
    base = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    return base.withColumn("tie", tie(F.col("text")))


def shapes(rows: DataFrame) -> DataFrame:
    """Narrow rows: conv_id, turn, role, tie and letter, with blank, duplicate and truncated as flags; no texts."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    narrow = rows.select("conv_id", "turn", "role", "tie", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    # the first of equal turns is none's repeat; which of several equal rows of one turn is first makes no difference
    earlier = Window.partitionBy("conv_id", "role", "tie").orderBy(F.asc_nulls_first("turn"))
    narrow = narrow.withColumn("again", ~F.col("blank") & (F.row_number().over(earlier) > 1))
    initial = F.substring("role", 1, 1)
    letter = F.when(F.col("blank") | F.col("again"), "x").otherwise(F.when(initial.isin("s", "u", "a"), F.when(F.col("open"), F.upper(initial)).otherwise(initial)).otherwise(F.when(F.col("open"), "O").otherwise("o")))
    return narrow.select("conv_id", "turn", "role", "tie", "blank", F.col("again").alias("duplicate"), (~F.col("blank") & ~F.col("again") & F.col("open")).alias("truncated"), letter.alias("letter"))


def grouped(rows: DataFrame, *order: str) -> DataFrame:
    """The rows of each conversation together and in order, read one after another: no conversation is held whole."""
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *[F.asc_nulls_first(o) for o in order])


def signatures(narrow: DataFrame) -> DataFrame:
    """conv_id, signature and the counts of each conversation."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]
        conv, letters, seen, out = None, None, None, []

        def close() -> None:
            turns = seen["high"] - seen["low"] + 1 - seen["turns"] if seen["turns"] else 0
            out.append((conv, "".join(letters), turns, seen["blank"], seen["duplicate"], seen["truncated"], seen["illegal"]))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 1 else pa.int64()) for i, c in enumerate(cols)], names=names)

        for batch in batches:
            for c, turn, role, blank, duplicate, truncated, letter in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "blank", "duplicate", "truncated", "letter")], strict=True):
                if seen is None or c != conv:
                    if seen is not None:
                        close()
                    conv, letters, seen = c, [], {"low": turn, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "role": None}
                if turn is not None and turn != seen["high"]:
                    seen["low"] = turn if seen["low"] is None else seen["low"]
                    seen["high"], seen["turns"] = turn, seen["turns"] + 1
                first = role[:1]
                seen["illegal"] += seen["role"] is not None and seen["role"] + first not in ("su", "ua", "au")
                seen["role"] = first
                seen["blank"] += blank
                seen["duplicate"] += duplicate
                seen["truncated"] += truncated
                letters.append(letter)
            if len(out) >= 4096:
                yield batch_of()
                out = []
        if seen is not None:
            close()
        if out:
            yield batch_of()

    kind = narrow.schema["conv_id"].dataType.simpleString()
    cols = narrow.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "tie", "blank", "duplicate", "truncated", "letter")
    out = grouped(cols, "turn", "role", "tie").mapInArrow(read, "conv_id bigint, signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def audits(distinct: DataFrame) -> DataFrame:
    """signature, n, cost and audit of distinct signatures, in ranges of their reversals."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Suffixes()
        for batch in batches:
            words = batch.column("signature").to_pylist()
            for at in range(0, len(words), 1024):
                found = [automaton.audit(w) for w in words[at : at + 1024]]
                yield pa.RecordBatch.from_arrays([batch.column("signature").slice(at, 1024), batch.column("n").slice(at, 1024), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["signature", "n", "cost", "audit"])

    back = distinct.withColumn("back", F.reverse("signature"))
    return back.repartitionByRange("back").sortWithinPartitions("back").select("signature", "n").mapInArrow(solve, "signature string, n bigint, cost bigint, audit string")


def repaired_turns(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The turns (role, text) after the edits of the audit."""
    state = START
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        to = NEXT[state][role[0]] if edit == "K" else next(t for r, t in NEXT[state].items() if r != "s")
        yield (role if edit == "K" else MADE[to]), text
        state = to


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id, place, role and text of the turns after repair; plan has conv_id and audit."""
    return _edited(rows, plan, lambda conv, turns: ((conv, i, r, t) for i, (r, t) in enumerate(turns)), [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())], "conv_id bigint, place bigint, role string, text string")


def digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, a digest of the repaired ``role:text``, newline-joined."""

    def digest(conv, turns):
        h, first = hashlib.sha256(), True
        for role, text in turns:
            h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        yield conv, h.hexdigest()

    return _edited(rows, plan, digest, [("conv_id", pa.int64()), ("repaired_sha256", pa.string())], "conv_id bigint, repaired_sha256 string")


def _edited(rows: DataFrame, plan: DataFrame, use, fields: list, ddl: str) -> DataFrame:
    """What ``use`` makes of each conversation's repaired turns, which are read one at a time. A conversation's plan comes before its turns."""
    nothing = F.lit(None).cast("string")
    heads = plan.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), nothing.alias("role"), nothing.alias("tie"), F.col("audit").alias("text"))
    turns = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.lit(1).alias("kind"), F.col("turn").cast("bigint").alias("turn"), "role", "tie", "text")
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    yield from zip(*[part.column(x).to_pylist() for x in ("conv_id", "kind", "role", "text")], strict=True)

        stream = every()
        ahead = next(stream, None)

        def own(conv):
            nonlocal ahead
            while ahead is not None and ahead[1] == 1 and ahead[0] == conv:
                role, text = ahead[2:]
                ahead = next(stream, None)
                yield role, text

        held, size = [], 0
        while ahead is not None:
            conv, _, _, audit = ahead
            ahead = next(stream, None)
            turns_ = own(conv)
            for row in use(conv, repaired_turns(audit, turns_)):
                held.append(row)
                size += sum(len(x) for x in row if isinstance(x, str))
                if size > 4 << 20 or len(held) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held, size = [], 0
            for _ in turns_:  # none is left unless the audit ends in deletions that were not asked for
                pass
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return grouped(heads.unionByName(turns), "kind", "turn", "role", "tie").mapInArrow(run, ddl)


def planned(rows: DataFrame) -> DataFrame:
    """conv_id, the counts, cost and audit of each conversation that has rows."""
    talks = written(signatures(shapes(rows)), "signatures")
    distinct = talks.groupBy("signature").agg(F.count("*").alias("n"))
    best = written(audits(distinct), "audits")
    # only short signatures go by broadcast when they are frequent
    short = skew_safe_join(talks.where(F.length("signature") <= LONG), best.where(F.length("signature") <= LONG), "signature", "n", F.xxhash64("conv_id").cast("string"))
    long = talks.where(F.length("signature") > LONG).join(best.where(F.length("signature") > LONG), "signature").select(short.columns)
    return written(short.unionByName(long), "repair_plan")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with seeded faults: dropped, emptied, cut open, repeated and user-only turns."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = (F.crc32(F.concat(none("conv_id"), F.lit(":"), none("turn")).cast("binary")) % 20).alias("code")
    rows = conversations.select("conv_id", "turn", none("role").alias("role"), none("text").alias("text"), code).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """All conversations after damage and repair: counts, cost, audit and the digest of the repaired turns."""
    rows = checked(damaged(conversations))
    plan = planned(rows)
    made = digests(rows, plan)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    # one row a conversation and, from the original, one for each, so that those without turns stay
    whole = plan.select("conv_id", *counts, "audit", F.lit(None).cast("string").alias("repaired_sha256"))
    hashes = made.select(F.col("conv_id").cast(plan.schema["conv_id"].dataType).alias("conv_id"), *[F.lit(None).cast("bigint").alias(c) for c in counts], F.lit(None).cast("string").alias("audit"), "repaired_sha256")
    all_ = conversations.select("conv_id").distinct().select("conv_id", *[F.lit(None).cast("bigint").alias(c) for c in counts], F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256"))
    first = lambda c, d: F.coalesce(F.max(c), F.lit(d)).alias(c)
    return all_.unionByName(whole).unionByName(hashes).groupBy("conv_id").agg(*[first(c, 0).cast("bigint").alias(c) for c in counts], first("audit", ""), first("repaired_sha256", hashlib.sha256(b"").hexdigest()))


#: The same results in SQL: from a conversation's end, the best (cost, audit, turns) of each grammar state (1 nothing yet, 2 system, 3 user, 4 assistant).
SQL = r"""with recursive o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
 h as (select *, list_reduce(list_concat([4294967295], flatten([[ascii(k[i]), -1, -1, -1, -1, -1, -1, -1, -1] for i in range(1, len(k) + 1)])), lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end) as reg from o),
 d as (select *, xor(reg, 4294967295) % 20 as code from h),
 r as (select conv_id, turn, case when code = 4 then 'user' else role end as role, case when code = 1 then '' when code = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when code = 3 then [0, 1] else [0] end) as n from d where code <> 0),
 f as (select *, row_number() over (partition by conv_id, role, text order by turn nulls first, n) as nth, substr(text, 1, 32) || chr(1) || md5(text) as tie,
   trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as bare, row_number() over (partition by conv_id order by turn nulls first, role, substr(text, 1, 32) || chr(1) || md5(text), n) as pos, count(*) over (partition by conv_id) as len from r),
 l as (select *, bare = '' as blank, bare <> '' and nth > 1 as dup, bare <> '' and nth = 1 and right(bare, 1) not in ('.', '!', '?') as cut, substr(role, 1, 1) as ini, lag(substr(role, 1, 1)) over (partition by conv_id order by pos) as prev from f),
 c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate, count(*) filter (cut) as truncated,
   count(*) filter (prev is not null and prev || ini not in ('su', 'ua', 'au')) as illegal, max(len) as len from l group by conv_id),
 w as (select conv_id, cast(0 as bigint) as k, [{'c': 0, 'a': '', 'r': ''}, {'c': 4, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)}, {'c': 2, 'a': 'I', 'r': 'assistant:' || chr(10)}, {'c': 0, 'a': '', 'r': ''}] as s from c
  union all select conv_id, k, [list_sort([b[i], {'c': 2 + b[[3, 3, 4, 3][i]].c, 'a': 'I' || b[[3, 3, 4, 3][i]].a, 'r': case when i = 3 then 'assistant:' else 'user:' end || chr(10) || b[[3, 3, 4, 3][i]].r},
     {'c': 4 + b[[4, 4, 3, 4][i]].c, 'a': 'II' || b[[4, 4, 3, 4][i]].a, 'r': case when i = 3 then 'assistant:' || chr(10) || 'user:' else 'user:' || chr(10) || 'assistant:' end || chr(10) || b[[4, 4, 3, 4][i]].r}])[1] for i in [1, 2, 3, 4]] as s
   from (select w.conv_id, w.k + 1 as k, [list_sort(list_filter([{'c': 3 + w.s[i].c, 'a': 'D' || w.s[i].a, 'r': w.s[i].r},
      case when not blank and not dup and ((ini = 's' and i = 1) or (ini = 'u' and i <> 3) or (ini = 'a' and i = 3)) then {'c': cast(cut as int) + w.s[case ini when 's' then 2 when 'u' then 3 else 4 end].c, 'a': 'K' || w.s[case ini when 's' then 2 when 'u' then 3 else 4 end].a, 'r': role || ':' || text || chr(10) || w.s[case ini when 's' then 2 when 'u' then 3 else 4 end].r} end,
      case when not blank and not dup then {'c': 2 + cast(cut as int) + w.s[[3, 3, 4, 3][i]].c, 'a': 'R' || w.s[[3, 3, 4, 3][i]].a, 'r': case when i = 3 then 'assistant:' else 'user:' end || text || chr(10) || w.s[[3, 3, 4, 3][i]].r} end], lambda x: x is not null))[1] for i in [1, 2, 3, 4]] as b
     from w join l on l.conv_id is not distinct from w.conv_id and l.pos = l.len - w.k))
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(s[1].c, 0) as bigint) as cost, coalesce(s[1].a, '') as audit,
 sha256(coalesce(substr(s[1].r, 1, length(s[1].r) - 1), '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join c on c.conv_id is not distinct from a.conv_id left join w on w.conv_id is not distinct from c.conv_id and w.k = c.len"""
