"""Repair of the structure of conversations (operator 13): A* on the edit lattice.

A conversation's rows, in order of their turns, are kept, given another role, deleted, or met by inserted rows, so
that the roles read ``(s?(ua)+)?`` at the least cost.  A state of the lattice is a number of rows passed and one
of four states of that pattern.  The heuristic is the sum of what the rows ahead cost in any case: 3 for each that
must be deleted and 1 for each truncated one (kept or given a role it is charged 1, deleted 3).  It never
falls by more than a move costs, so the first time a state leaves the queue, which is keyed by
(cost plus heuristic, audit), it does so at its least cost and with its least audit.

A conversation may hold a third of all rows.  Rows are put in order by ranges, so it lies over many tasks; it is cut into
segments of ``SEGMENT`` rows, each of which is searched from all four entry states to all four exit states.  A
conversation's segments are then followed in order: for each exit state the best way so far is kept, a way being
final as soon as all four agree on it, and each segment learns its entry state and its part of the audit.
Texts are never gathered by conversation, but for the digest, which is one hash over a conversation in order
and so streams through a task in batches.

Order, nulls and edge cases: rows go by turn with nulls first; rows of one turn go by role, then by the MD5 of the text, and
equal rows side by side, the second being a duplicate; null ids are one conversation; a null role or text is one space; an
initial is the first character of a role, and a role with another initial than s, u or a (or none) can't be kept;
a conversation all of whose rows are dropped has zeros, an empty audit and the hash of the empty string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import cut, table

#: Rows of a segment are 2^SEGMENT at most.
SEGMENT = 10
SPACE = " \t\n\x0b\x0c\r"
#: A row's symbol is the first one plus 4 times the place of its initial here (3: none of them) plus its fault.
INITIALS, FIRST = "sua", "A"
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: States of the pattern: nothing yet, after s, after u, after a; it may end in the first and the last.
ENDS = (0, 3)
ROLES = {2: "user", 3: "assistant"}
LEGAL = ("su", "ua", "au")
#: At most how much dearer the rows ahead are from the first state than from the second: by insertions, or by deleting a kept s.
DEARER = {(0, 1): 0, (0, 2): 2, (0, 3): 4, (1, 0): 4, (1, 2): 2, (1, 3): 4, (2, 0): 5, (2, 1): 2, (2, 3): 2, (3, 0): 3, (3, 1): 0, (3, 2): 2}


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage by the CRC of ``conv_id:turn``: conv_id, turn, role, text."""
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows with ``place``, which rises along each conversation; its higher bits name a segment."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_md5"), F.col("tie")]
    # Equal rows are told apart by ``tie``, so that no range has to hold all of a kind.
    rows = rows.withColumn("text_md5", F.unhex(F.md5("text"))).withColumn("tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "text_md5")
    return dealt.withColumn("place", F.monotonically_increasing_id())


def symbol(first: Column) -> Column:
    """A row's letter for initial and fault; ``first`` says that role and text come for the first time."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(~first, DUPLICATE).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(F.lit(ord(FIRST)) + kind * 4 + fault)


def segments(ordered: DataFrame) -> DataFrame:
    """conv_id, segment, its first place, and the symbols of its rows in order."""
    pair = F.unhex(F.md5(F.concat("role", F.lit("\0"), "text")))
    firsts = ordered.groupBy("conv_id", pair.alias("pair")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    marked = ordered.join(firsts, "place", "left").select("conv_id", "place", symbol(F.coalesce("first", F.lit(False))).alias("symbol"))
    listed = F.sort_array(F.collect_list(F.struct("place", "symbol")))
    out = marked.groupBy("conv_id", F.shiftright("place", SEGMENT).alias("segment")).agg(listed.alias("rows"))
    return out.select("conv_id", "segment", F.col("rows")[0]["place"].alias("place"), F.array_join(F.transform("rows", lambda r: r["symbol"]), "").alias("symbols"))


@lru_cache(maxsize=1 << 14)
def ways(symbols: str, entry: int) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) from ``entry`` to every exit state that can be reached, by A*."""
    rows = [divmod(ord(c) - ord(FIRST), 4) for c in symbols]
    ahead = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if rows[i][1] >= BLANK else CUT_OFF if rows[i][1] == TRUNCATED else 0)
    queue, done, found = [(ahead[0], "", 0, entry)], set(), {}
    while queue and len(found) < 4:
        total, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = total - ahead[i]
        after = 3 if state == 2 else 2
        moves = [(INSERT, "I", i, after)]
        if i == len(rows):
            found[state] = (cost, audit)
        else:
            initial, fault = rows[i]
            moves.append((DELETE, "D", i + 1, state))
            if fault < BLANK:
                charge = CUT_OFF * (fault == TRUNCATED)
                moves.append((REROLE + charge, "R", i + 1, after))
                if (initial, state) == (0, 0):
                    moves.append((charge, "K", i + 1, 1))
                elif initial + 1 == after:
                    moves.append((charge, "K", i + 1, after))
        for price, letter, j, to in moves:
            if (j, to) not in done:
                heapq.heappush(queue, (cost + price + ahead[j], audit + letter, j, to))
    return found


def illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def _initials(symbols: str) -> str:
    return "".join((INITIALS + "-")[(ord(c) - ord(FIRST)) // 4] for c in symbols)


class Follower:
    """Follows the segments of one conversation; ``settled`` holds (index, entry, cost, audit) of segments as they become final."""

    def __init__(self):
        #: By state: cost so far, and the steps that are not final yet.
        self.best: dict[int, tuple[int, list]] = {0: (0, [])}
        self.settled: list[tuple[int, int, int, str]] = []
        self.n, self.last = 0, ""

    def add(self, symbols: str, search=ways) -> int:
        """Take the next segment; returns its illegal pairs, the one across its front included."""
        reached: dict[int, tuple[int, str, list]] = {}
        for entry, (cost, steps) in self.best.items():
            before = "".join(s[3] for s in steps)
            for state, (more, audit) in search(symbols, entry).items():
                way = (cost + more, before + audit)
                if state not in reached or way < reached[state][:2]:
                    reached[state] = (*way, [*steps, (self.n, entry, more, audit)])
        # A state that another one beats whatever comes is left out.
        beaten = {y for (x, y), more in DEARER.items() if x in reached and y in reached and reached[x][0] + more < reached[y][0]}
        self.best = {state: (cost, steps) for state, (cost, _, steps) in reached.items() if state not in beaten}
        self.n += 1
        held = [steps for _, steps in self.best.values()]
        same = 0
        while len({s[same] if same < len(s) else None for s in held}) == 1 and same < len(held[0]):
            same += 1
        self.settled += held[0][:same]
        self.best = {state: (cost, steps[same:]) for state, (cost, steps) in self.best.items()}
        initials = self.last + _initials(symbols)
        self.last = initials[-1:]
        return illegal(initials)

    def close(self) -> None:
        _, steps = min(((cost, "".join(s[3] for s in steps)), steps) for state, (cost, steps) in self.best.items() if state in ENDS)
        self.settled += steps


SOLVED = ("conv_id", "segment", "place", "symbols", "entry", "cost", "illegal", "audit")


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by conversation and segment in, the same with entry, cost, illegal and audit out."""
    follower, now, waiting, out, kind = None, None, {}, [], None

    def settle() -> None:
        for n, entry, cost, audit in follower.settled:
            segment, place, symbols, pairs = waiting.pop(n)
            out.append((now, segment, place, symbols, entry, cost, pairs, audit))
        follower.settled.clear()

    def rows() -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], list(SOLVED))
        out.clear()
        return made

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, segment, place, symbols in zip(*(c.to_pylist() for c in batch.columns)):
            if follower is None or conv != now:
                if follower is not None:
                    follower.close()
                    settle()
                follower, now, waiting = Follower(), conv, {}
            n = follower.n
            waiting[n] = (segment, place, symbols, follower.add(symbols))
            settle()
        if out:
            yield rows()
    if follower is not None:
        follower.close()
        settle()
        yield rows()


def solve(found: DataFrame) -> DataFrame:
    """Each segment with its entry state, its part of the audit and of the cost, and its illegal pairs."""
    schema = T.StructType([found.schema["conv_id"], *T.StructType.fromDDL("segment long, place long, symbols string, entry int, cost long, illegal long, audit string").fields])
    dealt = found.select("conv_id", "segment", "place", "symbols").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return dealt.mapInArrow(_follow, schema)


def steps_of(place: int, symbols: str, entry: int, audit: str) -> list[tuple[int, int, str, str | None]]:
    """What stays of a segment, in order: (place, part, edit, new role); inserted rows go before or behind the row of their place."""
    out, state, row = [], entry, 0
    for k, letter in enumerate(audit):
        after = 3 if state == 2 else 2
        if letter == "I":
            at = (place + row, k - len(audit)) if row < len(symbols) else (place + row - 1, k + 1)
            out.append((*at, letter, ROLES[after]))
            state = after
            continue
        if letter == "R":
            out.append((place + row, 0, letter, ROLES[after]))
            state = after
        elif letter == "K":
            out.append((place + row, 0, letter, None))
            state = 1 if (ord(symbols[row]) - ord(FIRST)) // 4 == 0 else after
        row += 1
    return out


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, rows = [], []
        for k, work in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
            found = steps_of(*work)
            owner += [k] * len(found)
            rows += found
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            parts = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *parts], ["conv_id", "place", "part", "edit", "new_role"])


def repaired_rows(ordered: DataFrame, solved: DataFrame) -> DataFrame:
    """The rows of the repaired conversations (conv_id, place, part, edit, role, text), in order of place and part; places are met one by one, whatever their conversation."""
    schema = T.StructType([solved.schema["conv_id"], *T.StructType.fromDDL("place long, part int, edit string, new_role string").fields])
    steps = solved.select("conv_id", "place", "symbols", "entry", "audit").mapInArrow(_steps, schema)
    texts = ordered.select(F.col("place").alias("own_place"), F.col("role").alias("own_role"), F.col("text").alias("own_text"))
    stay = steps.where("edit <> 'I'").join(texts, F.col("place") == F.col("own_place"))
    stay = stay.select("conv_id", "place", "part", "edit", F.coalesce("new_role", "own_role").alias("role"), F.col("own_text").alias("text"))
    return stay.unionByName(steps.where("edit = 'I'").select("conv_id", "place", "part", "edit", F.col("new_role").alias("role"), F.lit("").alias("text")))


def digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines; a conversation streams through one task in batches, none is held whole."""
    schema = T.StructType([rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, kind = None, None, None
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, hashes = [], []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if running is None or conv != now:
                    if running is not None:
                        ids.append(now)
                        hashes.append(running.hexdigest())
                    now, running = conv, sha256()
                else:
                    running.update(b"\n")
                running.update(line.encode())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(hashes)], ["conv_id", "repaired_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([running.hexdigest()])], ["conv_id", "repaired_sha256"])

    lines = rows.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"), "place", "part")
    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place", "part").select("conv_id", "line")
    return dealt.mapInArrow(digest, schema)


def audits(ordered: DataFrame, solved: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost and audit."""
    # Segments bring counts; a conversation's audit is one string, as long as its edits.
    times = lambda fault: F.length("symbols") - F.length(F.translate("symbols", "".join(chr(ord(FIRST) + 4 * k + fault) for k in range(4)), ""))
    parts = F.sort_array(F.collect_list(F.struct("segment", "audit")))
    by_segment = solved.groupBy("conv_id").agg(
        F.sum(times(BLANK)).alias("blank"), F.sum(times(DUPLICATE)).alias("duplicate"), F.sum(times(TRUNCATED)).alias("truncated"),
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"),
    )
    turns = ordered.where("turn is not null").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    return by_segment.unionByName(gaps, allowMissingColumns=True)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired rows, and the report of each conversation with its digest, of ``rows(conv_id, turn, role, text)``.

    The report leaves out conversations without rows.
    """
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    ordered = cut(in_order(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *spaced)), "turns")
    solved = cut(solve(segments(ordered)), "repairs")
    out = repaired_rows(ordered, solved)
    return out, summed(audits(ordered, solved).unionByName(digests(out), allowMissingColumns=True))


def summed(report: DataFrame) -> DataFrame:
    """The parts of a conversation's report in one row."""
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    values = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in COUNTS] + [F.coalesce(F.max(c), empty[c]).alias(c) for c in empty]
    return report.groupBy("conv_id").agg(*values)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    _, report = repair(damage(given))
    return summed(report.unionByName(given.select("conv_id").distinct(), allowMissingColumns=True))


def _oracle() -> str:
    crc = "list_reduce(flatten(list_transform(range(1, length(key) + 1), lambda i: [ascii(key[i])::bigint, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end, 4294967295::bigint)"
    add = lambda state, price, letter: f"(lpad((substr(acc[{state + 1}], 1, 8)::bigint + {price})::varchar, 8, '0') || substr(acc[{state + 1}], 9) || '{letter}')"
    never = "'99000000'"
    keep = lambda state, initial: f"case when x[2] = '{initial}' and x[3] < '2' then {add(state, '(x[3] = ' + chr(39) + '1' + chr(39) + ')::int', 'K')} else {never} end"
    role = lambda state: f"case when x[3] < '2' then {add(state, '2 + (x[3] = ' + chr(39) + '1' + chr(39) + ')::int', 'R')} else {never} end"
    gone = lambda state: add(state, 3, "D")
    insert = f"[acc[1], acc[2], least(acc[3], {add(0, 2, 'I')}, {add(1, 2, 'I')}, {add(3, 2, 'I')}), least(acc[4], {add(2, 2, 'I')})]"
    move = (
        f"[{gone(0)}, least({gone(1)}, {keep(0, 's')}), least({gone(2)}, {keep(0, 'u')}, {keep(1, 'u')}, {keep(3, 'u')}, {role(0)}, {role(1)}, {role(3)}), "
        f"least({gone(3)}, {keep(2, 'a')}, {role(2)})]"
    )
    white = r"\x20\x09-\x0D"
    return rf"""
with k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations
), c as (
  select *, xor({crc}, 4294967295) % 20 as kind from k
), d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as again
  from c where kind <> 0
), p as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), again) as pos from d
), q as (
  select *, case when substr(role, 1, 1) in ('s', 'u', 'a') then substr(role, 1, 1) else '-' end as initial,
         case when not regexp_matches(text, '[^{white}]') then 2 when row_number() over (partition by conv_id, role, text order by pos) > 1 then 3
              when regexp_extract(text, '([^{white}])[{white}]*$', 1) in ('.', '!', '?') then 0 else 1 end as fault,
         lag(substr(role, 1, 1)) over (partition by conv_id order by pos) || substr(role, 1, 1) as pair
  from p
), g as (
  select conv_id, (coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0))::bigint as gaps, count(*) filter (where fault = 2) as blank,
         count(*) filter (where fault = 3) as duplicate, count(*) filter (where fault = 1) as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal,
         flatten([[['I', '', '']]] || list([['M', initial, fault::varchar], ['I', '', '']] order by pos)) as lattice
  from q group by conv_id
), s as (
  select * exclude (lattice), list_reduce(lattice, lambda acc, x: case when x[1] = 'I' then {insert} else {move} end, ['00000000', {never}, {never}, {never}]) as ends from g
), e as (
  select * exclude (ends), substr(least(ends[1], ends[4]), 1, 8)::bigint as cost, substr(least(ends[1], ends[4]), 9) as audit from s
), o as (
  select conv_id, audit, unnest(range(1, length(audit) + 1)) as i, length(replace(audit, 'D', '')) as n from e
), m as (
  select conv_id, i, audit[i] as op, length(replace(audit[:i], 'I', '')) as pos, length(replace(audit[:i], 'D', '')) as nth, n from o
), r as (
  select m.conv_id, sha256(string_agg(case when m.op = 'K' then q.role when (m.nth + m.n) % 2 = 0 then 'assistant' else 'user' end || ':' || case when m.op = 'I' then '' else q.text end, chr(10) order by m.i)) as sha
  from m left join q on q.conv_id is not distinct from m.conv_id and q.pos = m.pos where m.op <> 'D' group by m.conv_id
), a as (
  select distinct conv_id from conversations
)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from a left join e on a.conv_id is not distinct from e.conv_id left join r on a.conv_id is not distinct from r.conv_id
"""


ORACLE = _oracle()
