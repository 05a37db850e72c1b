"""Repair of conversation structure by a generalised LR parse with weighted edits.

The role grammar is LR; its automaton is made from the productions.  The graph-structured stack holds, for
each stack top, links to the stacks below it; stacks are interned, so equal ones are one node whatever
edits led to them, and the moves of a node (shift with the reductions it allows) are computed once.  At
every turn each live stack is extended by keeping, reroling or deleting the turn, and before it by insertions;
stacks that become equal are merged into the one of minimum (cost, audit).

Turns are sorted by range and numbered.  A segment is the turns of one conversation within `SEGMENT` numbers.
A conversation in one segment is parsed at once.  Of others, each segment is parsed from every
possible stack to every other: a small matrix of costs and of the order of their audits.  One fold over these,
smaller than the audit that the conversation gets as its result, chooses the stacks between segments, and
the segments are walked again between those.  No task holds the turns or texts of a conversation; the
hash of the repaired text is fed turn by turn, in order, by the task that has the conversation, since
SHA-256 cannot be split.

Equal costs: audits of one place are never a prefix of one another (both end in the same turn's edit), so
the smaller of two stays smaller whatever follows, and a minimum over segments is the minimum over all.

Defined cases: a null id is one conversation; a null role, text, id or turn number counts as one blank; turns without
a number come first; equal numbers are ordered by role and text; a repeated turn stands beside
its original; fully equal rows are turns of their own; a role whose first letter is not s, u or a cannot be
kept; a turn is truncated by its last character that is not white space; an empty table gives no
rows; a text may be of any length, a conversation of any number of turns; other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain.llm.storage import Scratch

SEGMENT = 4096
RULES = (("S", ""), ("S", "sT"), ("S", "T"), ("T", "ua"), ("T", "Tua"))  # capitals are nonterminals
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5  # prices; the last on top, for a truncated turn that stays
FAULTS = ("none", "blank", "duplicate", "truncated")
_SPACE = r"\x20\x09-\x0D"


# --- the role automaton ---------------------------------------------------------------------------------
class Automaton:
    """LR(0) item sets with one symbol of lookahead from FOLLOW; stacks are tuples of states, numbered."""

    def __init__(self, rules: tuple[tuple[str, str], ...] = RULES):
        self.rules = (("", rules[0][0]), *rules)
        start = self._closed({(0, 0)})
        self.states, self.goto = [start], {}
        for i, state in enumerate(self.states):
            for symbol in sorted({r[dot] for n, dot in state if dot < len(r := self.rules[n][1])}):
                to = self._closed({(n, dot + 1) for n, dot in state if self.rules[n][1][dot:dot + 1] == symbol})
                if to not in self.states:
                    self.states.append(to)
                self.goto[i, symbol] = self.states.index(to)
        self.follow = self._follow()
        self.stacks: list[tuple[int, ...]] = [(0,)]
        self.shift: list[dict[str, int]] = []
        for stack in self.stacks:
            self.shift.append({})
            for symbol in "sua":
                if (to := self._shifted(stack, symbol)) is not None:
                    if to not in self.stacks:
                        self.stacks.append(to)
                    self.shift[-1][symbol] = self.stacks.index(to)
        self.accepts = [self._reduced(stack, "$") is not None for stack in self.stacks]

    def _closed(self, items: set[tuple[int, int]]) -> frozenset:
        items, queue = set(items), list(items)
        for n, dot in queue:
            for m, (left, _) in enumerate(self.rules):
                if left and self.rules[n][1][dot:dot + 1] == left and (m, 0) not in items:
                    items.add((m, 0))
                    queue.append((m, 0))
        return frozenset(items)

    def _follow(self) -> dict[str, set[str]]:
        """What may stand after a nonterminal; only the first one may be empty."""
        first: dict[str, set[str]] = {}
        follow = {left: set() for left, _ in self.rules} | {self.rules[0][1]: {"$"}}
        for _ in self.rules:
            for left, right in self.rules:
                head = right[:1]
                first.setdefault(left, set()).update({head} if head.islower() else first.get(head, set()))
                for i, symbol in enumerate(right):
                    if symbol in follow:
                        after = right[i + 1:i + 2]
                        follow[symbol] |= follow[left] if not after else {after} if after.islower() else first.get(after, set())
        return follow

    def _reduced(self, stack: tuple[int, ...], ahead: str) -> tuple[int, ...] | None:
        """The stack after all reductions that the lookahead allows; None if `$` is not accepted."""
        while True:
            done = [self.rules[n] for n, dot in self.states[stack[-1]] if dot == len(self.rules[n][1])]
            if ahead == "$" and any(not left for left, _ in done):
                return stack
            ways = [(left, right) for left, right in done if left and ahead in self.follow[left]
                    and not (right == "" and (stack[-1], ahead) in self.goto)]
            if not ways:
                return None if ahead == "$" else stack
            (left, right), = ways  # the grammar has no conflicts
            stack = stack[:len(stack) - len(right)]
            stack = (*stack, self.goto[stack[-1], left])

    def _shifted(self, stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
        stack = self._reduced(stack, symbol)
        to = self.goto.get((stack[-1], symbol))
        if to is None:
            return None
        stack = (*stack, to)
        done = [self.rules[n] for n, dot in self.states[to] if dot == len(self.rules[n][1])]
        if len(done) == len(self.states[to]) == 1:  # nothing but one reduction is possible here
            (left, right), = done
            stack = stack[:len(stack) - len(right)]
            stack = (*stack, self.goto[stack[-1], left])
        return stack


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton()


# --- the parse -------------------------------------------------------------------------------------------
Live = dict[int, tuple[int, str]]  # stack -> (cost, audit)


def _offer(live: Live, stack: int, cost: int, audit: str) -> bool:
    if stack not in live or (cost, audit) < live[stack]:
        live[stack] = cost, audit
        return True
    return False


def inserted(live: Live) -> Live:
    """With any number of insertions at this place."""
    out, queue, shift = dict(live), list(live), automaton().shift
    for stack in queue:
        cost, audit = out[stack]
        for symbol in NAMES:
            to = shift[stack].get(symbol)
            if to is not None and _offer(out, to, cost + INSERT, audit + "I"):
                queue.append(to)
    return out


def parse(codes: bytes, begin: int) -> Live:
    """The stacks after the turns, from one before them; a code is 4 * fault + place of the initial in "sua?"."""
    live, shift = {begin: (0, "")}, automaton().shift
    for code in codes:
        fault, initial = FAULTS[code >> 2], "sua?"[code & 3]
        stay = TRUNCATED if fault == "truncated" else 0
        after: Live = {}
        for stack, (cost, audit) in inserted(live).items():
            _offer(after, stack, cost + DELETE, audit + "D")
            if fault in ("none", "truncated"):
                moves = shift[stack]
                if initial in moves:
                    _offer(after, moves[initial], cost + stay, audit + "K")
                for symbol in NAMES:
                    if symbol != initial and symbol in moves:
                        _offer(after, moves[symbol], cost + stay + REROLE, audit + "R")
        live = after
    return live


def ended(live: Live) -> tuple[int, str, int]:
    """The cheapest (cost, audit, stack before the last insertions) that the grammar accepts."""
    accepts = automaton().accepts
    return min((*way, before) for before, found in live.items()
               for to, way in inserted({before: found}).items() if accepts[to])


@lru_cache(maxsize=50_000)
def _remembered(codes: bytes, begin: int) -> Live:
    return parse(codes, begin)  # many conversations have the same shape


def _parse(codes: bytes, begin: int) -> Live:
    return _remembered(codes, begin) if len(codes) <= 64 else parse(codes, begin)


def steps(codes: bytes, begin: int, audit: str) -> list[tuple[str, str, str]]:
    """For each turn (roles inserted before it, edit, new role), and at the end the insertions after all."""
    shift, stack, at, out = automaton().shift, begin, 0, []
    for code in [*codes, None]:
        roles = ""
        while audit[at:at + 1] == "I":
            symbol, = [x for x in NAMES if x in shift[stack]]  # one role may follow, but for s
            roles, stack, at = roles + symbol, shift[stack][symbol], at + 1
        edit = audit[at:at + 1]
        at += 1
        symbol = ""
        if edit == "K":
            symbol = "sua"[code & 3]
        elif edit == "R":
            symbol, = [x for x in NAMES if x in shift[stack]]
        if symbol:
            stack = shift[stack][symbol]
        out.append((roles, edit, symbol if edit == "R" else ""))
    return out


def counts(codes: bytes) -> dict[str, int]:
    """Faults, neighbours that may not follow each other, and the initials at both ends."""
    initials = [c & 3 for c in codes]
    legal = {(0, 1), (1, 2), (2, 1)}  # su, ua, au
    return {**{f: sum(c >> 2 == k for c in codes) for k, f in enumerate(FAULTS) if k},
            "illegal": sum(pair not in legal for pair in zip(initials, initials[1:], strict=False)),
            "first": initials[0], "last": initials[-1]}


# --- steps on segments -------------------------------------------------------------------------------------
_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_EDITS = "array<struct<seq:bigint,inserted:string,edit:string,new_role:string,after:string>>"


def _codes_of(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[int], bytes]]:
    for row in batch.to_pylist():
        yield row, [t["seq"] for t in row["turns"]], bytes(t["code"] for t in row["turns"])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment of a longer conversation: (from, to, cost, rank of the audit), and its counts."""
    for batch in batches:
        for row, _, codes in _codes_of(batch):
            cells = [(begin, end, cost, audit) for begin in range(len(automaton().stacks))
                     for end, (cost, audit) in parse(codes, begin).items()]
            ranks = {a: i for i, a in enumerate(sorted({c[3] for c in cells}))}
            matrix = [x for begin, end, cost, audit in cells for x in (begin, end, cost, ranks[audit])]
            found = counts(codes)
            yield pa.RecordBatch.from_pydict({
                "conv": pa.array([row["conv"]], pa.string()), "seg": [row["seg"]],
                "matrix": pa.array([matrix], pa.list_(pa.int64())), **{k: [v] for k, v in found.items()}})


def choose(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """(stack before, stack after) of every segment on the cheapest way, of equals the one whose audits,
    compared segment by segment, come first."""
    best: dict[int, tuple[int, int]] = {0: (0, 0)}  # stack -> (cost, place in the order of audits)
    back: list[dict[int, int]] = []
    for flat in matrices:
        ways: dict[int, tuple[int, tuple[int, int], int]] = {}
        for i in range(0, len(flat), 4):
            begin, end, cost, rank = flat[i:i + 4]
            if begin in best:
                way = (best[begin][0] + cost, (best[begin][1], rank), begin)
                if end not in ways or way < ways[end]:
                    ways[end] = way
        order = {k: i for i, k in enumerate(sorted({w[1] for w in ways.values()}))}
        best = {end: (cost, order[key]) for end, (cost, key, _) in ways.items()}
        back.append({end: w[2] for end, w in ways.items()})
    # the last segment's audit goes on with insertions; its place in the order stands for all before it
    accepts = automaton().accepts
    final = min((cost + extra, place, len(tail), stack) for stack, (cost, place) in best.items()
                for to, (extra, tail) in inserted({stack: (0, "")}).items() if accepts[to])
    stack, out = final[3], []
    for ways_back in reversed(back):
        out.append((ways_back[stack], stack))
        stack = ways_back[stack]
    return out[::-1]


def _chosen(table: pa.Table) -> pa.Table:
    """The stacks around each segment of one conversation, and whether a neighbour before it is illegal."""
    rows = table.sort_by("seg").to_pylist()
    ways = choose([r["matrix"] for r in rows])
    legal = {(0, 1), (1, 2), (2, 1)}
    joints = [0, *[int((a["last"], b["first"]) not in legal) for a, b in zip(rows, rows[1:], strict=False)]]
    return pa.table({"conv": pa.array([r["conv"] for r in rows], pa.string()),
                     "seg": pa.array([r["seg"] for r in rows], pa.int64()),
                     "begin": pa.array([w[0] for w in ways], pa.int64()),
                     "end": pa.array([w[1] for w in ways], pa.int64()),
                     "joint": pa.array(joints, pa.int64()),
                     "closing": pa.array([i == len(rows) - 1 for i in range(len(rows))])})


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's turns with their edits (`edits`), its own part of the audit, its cost and counts."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("conv", "seg", "blank", "duplicate", "truncated", "illegal", "cost",
                                                "audit", "edits")}
        for row, seqs, codes in _codes_of(batch):
            begin, live = row["begin"], _parse(codes, row["begin"])
            if row["end"] is not None and not row["closing"]:
                cost, audit = live[row["end"]]
            elif row["end"] is not None:
                cost, audit, _ = ended({row["end"]: live[row["end"]]})
            else:
                cost, audit, _ = ended(live)
            *turns, tail = steps(codes, begin, audit)
            found = counts(codes)
            out["edits"].append([{"seq": s, "inserted": ins, "edit": e, "new_role": NAMES.get(r), "after": ""}
                                 for s, (ins, e, r) in zip(seqs, turns, strict=True)])
            out["edits"][-1][-1]["after"] = tail[0]
            for k, v in (("conv", row["conv"]), ("seg", row["seg"]), ("cost", cost), ("audit", audit),
                         *[(k, found[k] + (row["joint"] or 0) * (k == "illegal"))
                           for k in ("blank", "duplicate", "truncated", "illegal")]):
                out[k].append(v)
        edits = pa.list_(pa.struct([("seq", pa.int64()), ("inserted", pa.string()), ("edit", pa.string()),
                                    ("new_role", pa.string()), ("after", pa.string())]))
        kinds = {"conv": pa.string(), "audit": pa.string(), "edits": edits}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each conversation, which come together and in order."""
    now, held, some = None, None, False
    for batch in batches:
        done: list[tuple[str, str]] = []
        for conv, piece in zip(batch.column("conv").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if held is None or conv != now:
                if held is not None:
                    done.append((now, held.hexdigest()))
                now, held, some = conv, hashlib.sha256(), False
            if piece is not None:
                held.update((("\n" if some else "") + piece).encode())
                some = True
        yield pa.RecordBatch.from_pydict({"conv": pa.array([d[0] for d in done], pa.string()),
                                          "repaired_sha256": pa.array([d[1] for d in done], pa.string())})
    if held is not None:
        yield pa.RecordBatch.from_pydict({"conv": pa.array([now], pa.string()),
                                          "repaired_sha256": [held.hexdigest()]})


# --- on tables ---------------------------------------------------------------------------------------------
def damaged(turns: DataFrame) -> DataFrame:
    """A deterministic part of the rows spoilt: dropped, emptied, cut, repeated or given to the user."""
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(fill("conv_id"), F.lit(":"), fill("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(fill("text"), "[.!?]", "")) \
            .otherwise(fill("text"))
    return (turns.select("conv_id", "turn", "role", "text").withColumn("kind", kind).filter("kind <> 0")
                 .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(fill("role")).alias("role"),
                         text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1)))
                                                       .otherwise(F.array(F.lit(0)))).alias("copy"))
                 .drop("copy"))


def _key(conv_id: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def _parsed(turns: DataFrame, segment: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The numbered rows (conv, seq, turn, role, text) and a row a segment with its edits."""
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("place")]
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = scratch.write(
        turns.select(_key("conv_id").alias("conv"), "turn", blank("role").alias("role"), blank("text").alias("text"))
             .withColumn("place", F.monotonically_increasing_id())  # parts equal rows
             .repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("place")
             .withColumn("seq", F.monotonically_increasing_id()))
    last = F.regexp_extract("text", rf"([^{_SPACE}])[{_SPACE}]*\z", 1)
    initial = F.position(F.substring("role", 1, 1), F.lit("sua"))
    plain = rows.select("conv", "seq", "role", F.sha2("text", 256).alias("digest"), last.alias("last"),
                        F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1).alias("initial"))
    earliest = plain.groupBy("conv", "role", "digest").agg(F.min("seq").alias("earliest"))
    fault = (F.when(F.col("last") == "", 1).when(F.col("seq") > F.col("earliest"), 2)
              .when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0))
    coded = plain.join(earliest, ["conv", "role", "digest"]).select(
        "conv", "seq", (fault * 4 + F.col("initial")).alias("code"))
    cut = coded.groupBy("conv", F.floor(F.col("seq") / segment).alias("seg")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "code"))).alias("turns"))  # `segment` turns at most
    segments = scratch.write(cut)
    parts = segments.groupBy("conv").agg(F.count("*").alias("parts")).filter("parts > 1").select("conv")
    matrices = segments.join(parts, "conv", "left_semi").mapInArrow(
        _summaries, f"conv string, seg bigint, matrix array<bigint>, {_COUNTS}, first bigint, last bigint")
    ways = scratch.write(matrices.groupBy("conv").applyInArrow(
        _chosen, "conv string, seg bigint, begin bigint, end bigint, joint bigint, closing boolean"))
    walked = (segments.join(ways, ["conv", "seg"], "left").withColumn("begin", F.coalesce("begin", F.lit(0)))
              .mapInArrow(_walk, f"conv string, seg bigint, {_COUNTS}, cost bigint, audit string, edits {_EDITS}"))
    return rows, scratch.write(walked)


def edits(turns: DataFrame, segment: int = SEGMENT, scratch: Scratch | None = None) -> DataFrame:
    """Each turn with its place and its edit: conv (the id with `=` before it, empty for null), seq, turn, role, text,
    inserted and after (initials of empty turns around it), edit, new_role."""
    rows, walked = _parsed(turns, segment, scratch or Scratch(turns.sparkSession, "lr_repair"))
    return _with_edits(rows, walked)


def _with_edits(rows: DataFrame, walked: DataFrame) -> DataFrame:
    return rows.join(walked.select(F.inline("edits")), "seq")


def repair(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row a conversation of `turns` (conv_id, turn, role, text): gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256."""
    scratch = Scratch(turns.sparkSession, "lr_repair")
    rows, walked = _parsed(turns, segment, scratch)
    empty = lambda c: F.transform(F.split(c, ""), lambda x: F.when(x == "u", "user:").when(
        x == "a", "assistant:"))
    own = F.when(F.col("edit").isin("K", "R"), F.concat(F.coalesce("new_role", "role"), F.lit(":"), F.col("text")))
    pieces = F.array_compact(F.concat(empty(F.col("inserted")), F.array(own), empty(F.col("after"))))
    pieced = _with_edits(rows, walked).select("conv", "seq", F.when(F.size(pieces) > 0, F.array_join(pieces, "\n"))
                                              .alias("piece"))
    digests = (pieced.repartition("conv").sortWithinPartitions("conv", "seq").select("conv", "piece")
                     .mapInArrow(_digests, "conv string, repaired_sha256 string"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x.audit), "")
    summed = walked.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ordered.alias("audit"))
    turn = F.col("turn").cast("decimal(38,0)")  # the distance of two 64-bit numbers has 65
    missing = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count("turn"), F.lit(0).cast("decimal(38,0)"))
    spans = rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        F.least(missing, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint").alias("gaps"))
    ids = turns.select(_key("conv_id").alias("conv"), "conv_id").distinct()
    done = ids.join(spans, "conv").join(summed, "conv").join(digests, "conv")
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                       "repaired_sha256")


def with_unrepaired(ids: DataFrame, repaired: DataFrame) -> DataFrame:
    """A row for each of `ids` (conv_id): conversations without a turn have nothing to repair."""
    left = ids.select(_key("conv_id").alias("conv"), "conv_id")
    right = repaired.withColumn("conv", _key("conv_id")).drop("conv_id")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return left.join(right, "conv", "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
