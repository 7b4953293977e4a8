"""Conversation structure repair by generalised LR parsing with edits.

The order of roles is a grammar over role initials. A conversation is parsed
turn by turn; where a turn does not fit, the parser may delete it, give it
another role, or insert a turn without text, each at a price. All parses run
side by side on a graph-structured stack: stacks are linked nodes, shared
between parses, and equal stack tops at the same turn are merged, keeping the
smallest (cost, audit). The audit is the edits' initials in order: Keep,
Rerole, Delete, Insert; of the cheapest repairs the ASCII-least audit counts.

Two audits that end in the same turn's letter are equal or differ before
either ends, so tops carry the *rank* of their audit and the number of inserts
after it: ties are settled in constant time, however long the conversation.
Each top has a running digest of its repaired text. Turns therefore stream
through once; what is kept of each is its place in the audit (some 60 bytes),
no text. A conversation is one sequence and stays in one task, its turns are
sorted by Spark.

Faults of a turn, the first that holds: blank (nothing but ASCII white
space), duplicate (role and text seen earlier in the conversation), truncated
(the last other character is not ``.``, ``!`` or ``?``). Blank and duplicate
turns must go; an undeleted truncated turn adds to the cost.

Defined cases: turns are ordered by (turn, role, text), null turns first; null
role or text counts as one space; a null conv_id is a conversation of its own;
repeated rows are duplicates; conversations without turns (``conv_ids``) get
zeros, an empty audit and the hash of nothing; an empty table gives no rows;
other columns are ignored; a turn's text of any length is one value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import shuffle_partitions

#: s? (u a)+ or nothing
ROLE_GRAMMAR = (("C", ()), ("C", ("P",)), ("C", ("s", "P")), ("P", ("u", "a")), ("P", ("P", "u", "a")))
ROLES = {"u": "user", "a": "assistant"}          # what a turn can become or be inserted as
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
END = "$"


class Grammar:
    """SLR tables of a grammar, and stacks as shared linked nodes: node i is
    (state, node below it), and equal nodes are the same node."""

    def __init__(self, productions):
        self.rules = [("^", (productions[0][0],)), *productions]
        self.names = {lhs for lhs, _ in self.rules}
        self.states, self.goto = [], {}
        self._follow()
        self._state(frozenset([(0, 0)]))
        self.nodes, self.node_of, self.memo = [], {}, {}
        self.bottom = self._node(0, -1)

    def _first(self, symbols, firsts, nullable):
        out = set()
        for s in symbols:
            out |= firsts[s] if s in self.names else {s}
            if s not in nullable:
                return out, False
        return out, True

    def _follow(self):
        firsts, nullable = {n: set() for n in self.names}, set()
        self.follow = {n: set() for n in self.names}
        self.follow["^"].add(END)
        while True:
            before = sum(map(len, (*firsts.values(), *self.follow.values(), nullable)))
            for lhs, rhs in self.rules:
                first, empty = self._first(rhs, firsts, nullable)
                firsts[lhs] |= first
                if empty:
                    nullable.add(lhs)
                for k, s in enumerate(rhs):
                    if s in self.names:
                        after, open_end = self._first(rhs[k + 1:], firsts, nullable)
                        self.follow[s] |= after | (self.follow[lhs] if open_end else set())
            if sum(map(len, (*firsts.values(), *self.follow.values(), nullable))) == before:
                return

    def _state(self, kernel) -> int:
        items, todo = set(kernel), list(kernel)
        while todo:
            rule, dot = todo.pop()
            rhs = self.rules[rule][1]
            if dot < len(rhs) and rhs[dot] in self.names:
                for k, (lhs, _) in enumerate(self.rules):
                    if lhs == rhs[dot] and (k, 0) not in items:
                        items.add((k, 0))
                        todo.append((k, 0))
        items = frozenset(items)
        if items in self.states:
            return self.states.index(items)
        n = len(self.states)
        self.states.append(items)
        for s in {self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}:
            self.goto[n, s] = self._state(frozenset((r, d + 1) for r, d in items
                                                    if d < len(self.rules[r][1]) and self.rules[r][1][d] == s))
        return n

    def _node(self, state: int, below: int) -> int:
        key = (state, below)
        if key not in self.node_of:
            self.node_of[key] = len(self.nodes)
            self.nodes.append(key)
        return self.node_of[key]

    def _reduced(self, node: int, rule: int) -> int:
        lhs, rhs = self.rules[rule]
        for _ in rhs:
            node = self.nodes[node][1]
        return self._node(self.goto[self.nodes[node][0], lhs], node)

    def _before(self, node: int, symbol: str) -> set[int]:
        """The stack and all it reduces to with ``symbol`` ahead."""
        seen, todo = {node}, [node]
        while todo:
            at = todo.pop()
            for rule, dot in self.states[self.nodes[at][0]]:
                lhs, rhs = self.rules[rule]
                if rule and dot == len(rhs) and symbol in self.follow[lhs]:
                    to = self._reduced(at, rule)
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
        return seen

    def after(self, node: int, symbol: str) -> tuple[int, ...]:
        """Stacks after reading ``symbol`` on this one."""
        key = (node, symbol)
        if key not in self.memo:
            shifted = {self._node(self.goto[self.nodes[n][0], symbol], n)
                       for n in self._before(node, symbol) if (self.nodes[n][0], symbol) in self.goto}
            self.memo[key] = tuple(sorted(map(self._settled, shifted)))
        return self.memo[key]

    def _settled(self, node: int) -> int:
        """Reduced as long as nothing else is possible, so that equal parses meet."""
        while len(items := self.states[self.nodes[node][0]]) == 1:
            rule, dot = next(iter(items))
            if not rule or dot < len(self.rules[rule][1]):
                break
            node = self._reduced(node, rule)
        return node

    def accepts(self, node: int) -> bool:
        return any((0, 1) in self.states[self.nodes[n][0]] for n in self._before(node, END))


class _Top:
    """A stack top: price so far, rank of the audit up to the last turn, the
    inserts after it, and the digest of the repaired text."""

    __slots__ = ("cost", "rank", "inserts", "base", "digest", "empty")

    def __init__(self, cost, rank, inserts, base, digest, empty):
        self.cost, self.rank, self.inserts, self.base, self.digest, self.empty = \
            cost, rank, inserts, base, digest, empty

    def written(self, role: str, text: str):
        d = self.digest.copy()
        d.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        return d


class Parse:
    """The repairs of one conversation, turn by turn."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.trace = grammar, []
        self.tops = {grammar.bottom: _Top(0, 0, 0, 0, hashlib.sha256(), True)}
        self._insert()

    def _insert(self) -> None:
        """Insert turns wherever that opens a stack or makes it cheaper."""
        fresh = dict(self.tops)
        while fresh:
            found = {}
            for node, top in fresh.items():
                for symbol, role in ROLES.items():
                    for to in self.grammar.after(node, symbol):
                        key = (top.cost + INSERT, top.rank, top.inserts + 1)
                        for pool in (self.tops, found):
                            other = pool.get(to)
                            if other and (other.cost, other.rank, other.inserts) <= key:
                                break
                        else:
                            found[to] = _Top(*key, top.base, top.written(role, ""), False)
            self.tops |= found
            fresh = found

    def turn(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """Read a turn: every top deletes it, keeps it or gives it a role."""
        best: dict = {}
        extra = TRUNCATED if truncated else 0
        for node, top in self.tops.items():
            edits = [(DELETE, "D", None, node)]
            if not must_go:
                edits += [(KEEP + extra, "K", role, to) for to in self.grammar.after(node, role[:1])]
                edits += [(REROLE + extra, "R", r, to) for s, r in ROLES.items() for to in self.grammar.after(node, s)]
            for price, letter, new_role, to in edits:
                key = (top.cost + price, top.rank, "I" * top.inserts + letter)
                if to not in best or key < best[to][0]:
                    best[to] = (key, top, new_role)
        ranks = {audit: n for n, audit in enumerate(sorted({key[1:] for key, _, _ in best.values()}))}
        row, self.tops = bytearray(), {}
        for base, (node, (key, top, new_role)) in enumerate(best.items()):
            row += bytes((top.base, top.inserts, ord(key[2][-1])))
            digest = top.digest if new_role is None else top.written(new_role, text)
            self.tops[node] = _Top(key[0], ranks[key[1:]], 0, base, digest, top.empty and new_role is None)
        self.trace.append(bytes(row))
        self._insert()

    def best(self) -> tuple[int, str, str]:
        """(cost, audit, digest) of the best repair."""
        top = min((t for n, t in self.tops.items() if self.grammar.accepts(n)),
                  key=lambda t: (t.cost, t.rank, "I" * t.inserts))
        audit, base = ["I" * top.inserts], top.base
        for row in reversed(self.trace):
            base, inserts, letter = row[3 * base:3 * base + 3]
            audit.append("I" * inserts + chr(letter))
        return top.cost, "".join(reversed(audit)), top.digest.hexdigest()


class _Conversation:
    def __init__(self, conv_id, grammar: Grammar):
        self.conv_id, self.parse = conv_id, Parse(grammar)
        self.least = self.most = self.initial = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            if self.least is None:
                self.least = turn
            if turn != self.most:
                self.most = turn
                self.distinct += 1
        if self.initial is not None and (self.initial, role[:1]) not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        rest = text.rstrip(SPACE)
        blank = not rest
        duplicate = not blank and seen
        truncated = not blank and not duplicate and rest[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.parse.turn(role, text, blank or duplicate, truncated)

    def row(self) -> tuple:
        cost, audit, digest = self.parse.best()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest)


_NAMES = [c.split()[0] for c in REPORT.split(", ")]
_TYPES = [pa.int64()] * 7 + [pa.string()] * 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)


def _repair(productions):
    """Sorted (conv_id, turn, role, text, seen) -> a row per conversation."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        grammar, now, rows = Grammar(productions), None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for conv_id, turn, role, text, seen in zip(*(c.to_pylist() for c in part.columns)):
                    if now is None or conv_id != now.conv_id:
                        if now is not None:
                            rows.append(now.row())
                        now = _Conversation(conv_id, grammar)
                    if text is not None:
                        now.add(turn, role, text, seen)
            if len(rows) > 5_000:
                yield _batch(rows)
                rows = []
        if now is not None:
            rows.append(now.row())
        yield _batch(rows)

    return run


def _ordered(turns: DataFrame, conv_ids: DataFrame | None) -> DataFrame:
    """Turns in order within each conversation with ``seen``; a conversation
    of ``conv_ids`` also has a row without text. One shuffle, by
    conversation: the look-out for earlier turns uses the same."""
    space = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    if conv_ids is not None:
        marks = conv_ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        rows = rows.unionByName(marks, allowMissingColumns=True)
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    w = Window.partitionBy("conv_id", "_same").orderBy(F.col("turn").asc_nulls_first())
    return (rows.withColumn("_same", same).repartition(shuffle_partitions(turns.sparkSession), "conv_id")
            .withColumn("seen", F.row_number().over(w) > 1).drop("_same")
            .sortWithinPartitions("conv_id", *order))


def repair(turns: DataFrame, conv_ids: DataFrame | None = None, productions=ROLE_GRAMMAR) -> DataFrame:
    """The ``REPORT`` row of every conversation in ``turns(conv_id, turn,
    role, text)`` and, where given, of every one in ``conv_ids``."""
    return _ordered(turns, conv_ids).mapInArrow(_repair(productions), REPORT)


TURNS = "conv_id long, place long, role string, text string"


class _Repaired:
    """Carries out one conversation's audit on its turns in order."""

    def __init__(self, conv_id, audit: str):
        self.conv_id, self.audit, self.at, self.place = conv_id, audit, 0, 0
        self.odd = (len(audit) - audit.count("D")) % 2      # an odd number of turns starts with a system turn

    def _put(self, role: str | None, text: str) -> tuple:
        self.place += 1
        return self.conv_id, self.place - 1, role or ROLES["ua"[(self.place - 1 - self.odd) % 2]], text

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._put(None, "")

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter != "D":
            yield self._put(role if letter == "K" else None, text)


def _apply(batches) -> Iterator[pa.RecordBatch]:
    now, out = None, []
    for batch in batches:
        for conv_id, audit, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is not None:
                if now is not None:
                    out.extend(now.inserted())
                now = _Repaired(conv_id, audit)
            else:
                out.extend(now.turn(role, text))
        yield _turns(out)
        out = []
    if now is not None:
        out.extend(now.inserted())
    yield _turns(out)


def _turns(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(),
                                                                             pa.string()))],
                                      names=["conv_id", "place", "role", "text"])


def repaired_turns(turns: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired conversations themselves, ``(conv_id, place, role,
    text)``, by the audits of ``repair`` over the same turns (role grammar)."""
    space = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(None).cast("string").alias("audit"),
                        F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
                        F.coalesce("text", space).alias("text"))
    # a conversation's audit comes before its turns
    both = rows.unionByName(report.select("conv_id", "audit"), allowMissingColumns=True)
    return (both.repartition(shuffle_partitions(turns.sparkSession), "conv_id")
            .sortWithinPartitions("conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "text")
            .mapInArrow(_apply, TURNS))


def damage(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by a rule over ``conv_id:turn``, to test
    repairs with: of 20 remainders 0 drops a turn, 1 empties its text, 2 takes
    out its stops, 3 repeats it, 4 makes it the user's. Nulls are a space."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    d = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     text[2].alias("role"), text[3].alias("text"),
                     (F.crc32(F.concat(text[0], F.lit(":"), text[1])) % 20).alias("_fault"))
    fault = F.col("_fault")
    return (d.filter(fault != 0)
            .withColumn("text", F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", ""))
                        .otherwise(F.col("text")))
            .withColumn("role", F.when(fault == 4, "user").otherwise(F.col("role")))
            .withColumn("_n", F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .drop("_fault", "_n"))
