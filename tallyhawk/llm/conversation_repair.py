"""Repair of damaged conversations: Re-Pair grammars of role and fault symbols, a min-plus matrix with audit ropes for each rule."""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space as the faults have it.
SPACE = " \t\n\x0b\x0c\r"
ROLES = "sua"
#: A symbol is the row's role initial (s, u, a, other) and fault (none, truncated, blank, duplicate).
FIRST = 65
FAULTS = ("", "truncated", "blank", "duplicate")
#: Symbols of a conversation that are one sequence, and symbols and sequences that share a grammar.
SEQUENCE, SYMBOLS, SEQUENCES = 4_096, 200_000, 20_000
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn; the first and last may end.
STATES, ENDS = 4, (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Ropes:
    """Texts made of others, each kept once: equal ids are equal texts, and joining costs the same at any length."""

    def __init__(self) -> None:
        self.made: dict[object, int] = {"": 0}
        self.parts: list = [""]

    def text(self, s: str) -> int:
        return self._keep(s)

    def _keep(self, part: object) -> int:
        i = self.made.get(part)
        if i is None:
            i = self.made[part] = len(self.parts)
            self.parts.append(part)
        return i

    def join(self, a: int, b: int) -> int:
        if not a or not b:
            return a or b
        x, y = self.parts[a], self.parts[b]
        if isinstance(x, str) and isinstance(y, str) and len(x) + len(y) <= 16:
            return self._keep(x + y)
        return self._keep((a, b))

    def less(self, a: int, b: int) -> bool:
        """Does the first text come before the second? Parts that both share are passed over unread."""
        left, right = [a], [b]
        while left and right:
            x, y = left.pop(), right.pop()
            if x == y:
                continue
            p = x if isinstance(x, str) else self.parts[x]
            q = y if isinstance(y, str) else self.parts[y]
            if isinstance(p, tuple):
                left += [p[1], p[0]]
                right.append(y)
            elif isinstance(q, tuple):
                right += [q[1], q[0]]
                left.append(x)
            else:
                n = min(len(p), len(q))
                if p[:n] != q[:n]:
                    return p[:n] < q[:n]
                if len(p) > n:
                    left.append(p[n:])
                if len(q) > n:
                    right.append(q[n:])
        return bool(right) and not left

    def read(self, a: int) -> str:
        out, todo = [], [a]
        while todo:
            part = self.parts[todo.pop()]
            if isinstance(part, tuple):
                todo += [part[1], part[0]]
            else:
                out.append(part)
        return "".join(out)


Cell = tuple[int, int]  # cost and rope
Matrix = dict[tuple[int, int], Cell]


class Transfers:
    """Cheapest edits between states, as min-plus matrices over (cost, audit).

    Of equally cheap edits the audit that is least as text counts. For the same rows, no audit is the beginning
    of another one of equal cost (it would differ by insertions only, which cost), so the order of two texts stays
    when both go on alike, and matrices may be multiplied in any grouping.
    """

    def __init__(self) -> None:
        self.ropes = Ropes()
        insert = self.ropes.text("I")
        twice = self.ropes.join(insert, insert)
        self.rest: Matrix = {(i, i): (0, 0) for i in range(STATES)}
        self.rest |= {(i, j): (INSERT, insert) for i, j in ((0, 2), (1, 2), (2, 3), (3, 2))} | {(i, 3): (2 * INSERT, twice) for i in (0, 1)}
        self.known: dict[int, Matrix] = {}

    def better(self, a: Cell | None, b: Cell) -> bool:
        return a is None or b[0] < a[0] or (b[0] == a[0] and b[1] != a[1] and self.ropes.less(b[1], a[1]))

    def times(self, x: Matrix, y: Matrix) -> Matrix:
        rows: dict[int, list[tuple[int, Cell]]] = defaultdict(list)
        for (i, j), cell in y.items():
            rows[i].append((j, cell))
        out: Matrix = {}
        ropes = self.ropes
        for (i, k), (c, a) in x.items():
            for j, (d, b) in rows[k]:
                old = out.get((i, j))
                if old is None or c + d <= old[0]:
                    cell = (c + d, ropes.join(a, b))
                    if self.better(old, cell):
                        out[i, j] = cell
        return out

    def symbol(self, code: int) -> Matrix:
        """One row's edits, with insertions before and after."""
        if code not in self.known:
            role, fault = ROLES[code // 4 : code // 4 + 1], FAULTS[code % 4]
            edits = {}
            for i in range(STATES):
                options = [(i, DELETE, "D")]
                if fault in ("", "truncated"):
                    more = TRUNCATED if fault else 0
                    options += [(STEP.get((i, role)), KEEP + more, "K"), *[(STEP.get((i, r)), REROLE + more, "R") for r in "ua"]]
                for j, cost, letter in options:
                    cell = (cost, self.ropes.text(letter))
                    if j is not None and self.better(edits.get((i, j)), cell):
                        edits[i, j] = cell
            self.known[code] = self.times(self.times(self.rest, edits), self.rest)
        return self.known[code]


def re_pair(sequences: list[bytes]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """``(rules, sequences)``: the most frequent pair of neighbours becomes a new symbol until no pair is there twice.

    Symbols below 16 are those of the input; rule ``i`` is symbol ``16 + i``. Pairs don't cross sequences.
    """
    flat: list[int] = []
    starts = []
    for s in sequences:
        starts.append(len(flat))
        flat += [b - FIRST for b in s]
        flat.append(-1)
    n = len(flat)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i in range(n - 1):
        if flat[i] >= 0 and flat[i + 1] >= 0:
            places[flat[i], flat[i + 1]].add(i)
    queue = [(-len(p), pair) for pair, p in places.items() if len(p) > 1]
    heapq.heapify(queue)
    rules: list[tuple[int, int]] = []
    while queue:
        count, pair = heapq.heappop(queue)
        found = places.get(pair, ())
        if len(found) != -count:
            if len(found) > 1:
                heapq.heappush(queue, (-len(found), pair))
            continue
        new = 16 + len(rules)
        rules.append(pair)
        changed = set()
        for i in sorted(places.pop(pair)):
            j = after[i]
            if flat[i] != pair[0] or j >= n or flat[j] != pair[1]:
                continue  # an overlapping place is used up
            k, h = after[j], before[i]
            if h >= 0 and flat[h] >= 0:
                places[flat[h], flat[i]].discard(h)
                places[flat[h], new].add(h)
                changed.add((flat[h], new))
            if flat[k] >= 0:
                places[flat[j], flat[k]].discard(j)
                places[new, flat[k]].add(i)
                changed.add((new, flat[k]))
            flat[i], flat[j] = new, -2
            after[i], before[k] = k, i
        places.pop(pair, None)
        for p in changed:
            if len(places[p]) > 1:
                heapq.heappush(queue, (-len(places[p]), p))
    out = []
    for i in starts:
        top = []
        while flat[i] >= 0:
            top.append(flat[i])
            i = after[i]
        out.append(top)
    return rules, out


def transfer(sequences: list[bytes]) -> tuple[Transfers, list[Matrix]]:
    """The matrix of each sequence, by one grammar that all of them share."""
    made = Transfers()
    different = list(dict.fromkeys(sequences))
    rules, tops = re_pair(different)
    matrices = {code: made.symbol(code) for top in tops for code in top if code < 16} | {code: made.symbol(code) for pair in rules for code in pair if code < 16}
    for i, (a, b) in enumerate(rules):  # a rule's parts come before it
        matrices[16 + i] = made.times(matrices[a], matrices[b])
    whole = {}
    for s, top in zip(different, tops, strict=True):
        m = made.rest
        for k, code in enumerate(top):
            m = made.times(m, matrices[code]) if k else matrices[code]
        whole[s] = m
    return made, [whole[s] for s in sequences]


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, kept``: rows by the checksum of their place: dropped, emptied, unended, repeated or given to the user."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind != 0).alias("kept"), copies.alias("copy")).drop("copy")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def symbols(damaged: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, symbol``: each row's role initial and first fault as a number; null for a dropped row."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    cut_off = ~F.substring(trimmed, -1, 1).isin(".", "!", "?")
    rows = damaged.select("conv_id", "turn", "role", _digest(), "kept", (trimmed == "").alias("blank"), cut_off.alias("cut_off"))
    order = Window.partitionBy("conv_id", "role", "digest", "kept").orderBy("turn")
    rows = rows.withColumn("seen", F.row_number().over(order) > 1)
    fault = F.when(F.col("blank"), 2).when(F.col("seen"), 3).when(F.col("cut_off"), 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.select("conv_id", "turn", "role", "digest", F.when(F.col("kept"), role * 4 + fault).cast("tinyint").alias("symbol"))


def _runs(keys: pa.Array) -> list[tuple[object, int, int]]:
    """``(key, start, end)`` of equal neighbours; nulls are equal to each other."""
    if not len(keys):
        return []
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    cuts = np.flatnonzero(np.diff(codes)) + 1
    starts = [0, *cuts.tolist()]
    ends = [*cuts.tolist(), len(codes)]
    return [(keys[a].as_py(), a, b) for a, b in zip(starts, ends, strict=True)]


class _Counts:
    """What a task knows of the conversation whose rows it is reading: a byte a row until a sequence is full."""

    def __init__(self, key: object) -> None:
        self.key, self.row = key, [0] * len(NUMBERS)
        self.low = self.high = self.last = self.initial = None
        self.turns = 0
        self.waiting = bytearray()

    def add(self, turns: np.ndarray, known: np.ndarray, codes: np.ndarray) -> None:
        _, blank, duplicate, truncated, illegal, _ = self.row
        times = turns[known]
        if len(times):
            self.turns += int(np.count_nonzero(np.diff(times))) + (self.last is None or self.last != int(times[0]))
            self.low = int(times[0]) if self.low is None else self.low
            self.high = self.last = int(times[-1])
        if not len(codes):
            return
        fault, role = codes % 4, codes // 4
        pairs = [] if self.initial is None else [(self.initial, int(role[0]))]
        fits = ((role[:-1] == 0) & (role[1:] == 1)) | ((role[:-1] == 1) & (role[1:] == 2)) | ((role[:-1] == 2) & (role[1:] == 1))
        illegal += int(np.count_nonzero(~fits)) + sum(p not in ((0, 1), (1, 2), (2, 1)) for p in pairs)
        self.initial = int(role[-1])
        n = np.bincount(fault, minlength=4).tolist()
        self.row = [0, blank + n[2], duplicate + n[3], truncated + n[1], illegal, 0]
        self.waiting += (codes + FIRST).astype(np.uint8).tobytes()


def plan_repairs(rows: DataFrame) -> DataFrame:
    """``conv_id``, the numbers and the ``audit`` of each conversation of ``symbols``.

    Rows come sorted through a task. Its sequences wait until there are enough of them for a grammar; each
    conversation then multiplies its sequences' matrices in order.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[_Counts, bytes, bool]] = []  # a sequence, and whether it is its conversation's last
        begun: dict[int, dict[int, tuple[int, str]]] = {}  # costs and audits of the conversation that goes on
        held, id_type = 0, None

        def settle() -> pa.RecordBatch:
            made, matrices = transfer([s for _, s, _ in waiting])
            done = []
            for (counts, _, last), m in zip(waiting, matrices, strict=True):
                begins = begun.pop(id(counts), {0: (0, "")})
                states: dict[int, tuple[int, str]] = {}
                for (i, j), (cost, rope) in m.items():
                    if i in begins:
                        cell = (begins[i][0] + cost, begins[i][1] + made.ropes.read(rope))
                        states[j] = min(states.get(j, cell), cell)
                if last:
                    cost, audit = min(states[j] for j in ENDS if j in states)
                    gaps = 0 if counts.low is None else counts.high - counts.low + 1 - counts.turns
                    done.append((counts.key, [gaps, *counts.row[1:5], cost], audit))
                else:
                    begun[id(counts)] = states
            waiting.clear()
            columns = [pa.array([d[1][k] for d in done], pa.int64()) for k in range(len(NUMBERS))]
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], id_type), *columns, pa.array([d[2] for d in done], pa.string())], ["conv_id", *NUMBERS, "audit"])

        now: _Counts | None = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            turns = batch.column(1)
            times, known = turns.fill_null(0).to_numpy(), turns.is_valid().to_numpy(zero_copy_only=False)
            there = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            codes = batch.column(2).fill_null(0).to_numpy().astype(np.int64)
            for key, a, b in _runs(batch.column(0)):
                if now is not None and now.key != key:
                    waiting.append((now, bytes(now.waiting), True))
                    held += len(now.waiting)
                    now = None
                now = now or _Counts(key)
                keep = there[a:b]
                now.add(times[a:b][keep], known[a:b][keep], codes[a:b][keep])
                while len(now.waiting) > SEQUENCE:
                    waiting.append((now, bytes(now.waiting[:SEQUENCE]), False))
                    del now.waiting[:SEQUENCE]
                    held += SEQUENCE
                if held > SYMBOLS or len(waiting) > SEQUENCES:
                    yield settle()
                    held = 0
        if now is not None:
            waiting.append((now, bytes(now.waiting), True))
            yield settle()

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "symbol").select("conv_id", "turn", "symbol")  # of equal rows the later ones are duplicates
    return dealt.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{n} long' for n in NUMBERS)}, audit string")


class _Text:
    """The repaired conversation as far as its rows have come: a hash, not a text."""

    def __init__(self, numbers: list, audit: str, keep: bool) -> None:
        self.numbers, self.audit, self.at, self.state = numbers, audit, 0, 0
        self.hash, self.any, self.turns = hashlib.sha256(), False, [] if keep else None

    def put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True
        self.state = STEP[self.state, role[0]]
        if self.turns is not None:
            self.turns.append((role, text))

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.put("assistant" if self.state == 2 else "user", "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.put(role if edit == "K" else "assistant" if self.state == 2 else "user", text)


def repair(turns: DataFrame, *, damaged: bool = False, texts: bool = False) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for every conversation.

    ``turns`` has conv_id, turn, role and text; they are damaged first, unless they are ``damaged`` already. With
    ``texts`` the repaired turns come as ``repaired``, an array of (role, text).

    Repeated turns are told by conversation, role and text, whatever the conversation's length. Symbols of rows
    are then sorted by conversation; a grammar is shared by the conversations that wait in a task. The audit
    travels to the texts as a first row of its conversation. A conversation passes through one task in order, since its
    result is one hash, but as a stream: a task holds a byte a row and an audit, never its texts.

    Null roles and texts are one space; a null conv_id is a conversation of its own; null turns come first and
    count for no gap; rows of the same turn are ordered by role and the SHA-256 of the text; empty texts are blank, very long ones
    are read whole; repeated rows are duplicates; a conversation without rows has zeros, an empty audit and the
    hash of the empty text; other columns are not read; an empty table gives an empty table.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(True).alias("kept")) if damaged else damage(turns)
    plans = plan_repairs(symbols(rows))
    first = plans.select("conv_id", F.lit(0).alias("order"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"), F.array(*NUMBERS).alias("numbers"))
    then = rows.where("kept").select("conv_id", F.lit(1).alias("order"), "turn", "role", "text", _digest(), F.lit(None).cast("array<long>").alias("numbers"))
    names = ["conv_id", *NUMBERS, "audit", "repaired_sha256"] + (["repaired"] if texts else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[object, _Text] | None = None
        id_type = None

        def finish(done: list[tuple[object, _Text]]) -> pa.RecordBatch:
            for _, t in done:
                t.inserted()
            columns = [pa.array([k for k, _ in done], id_type), *[pa.array([t.numbers[i] for _, t in done], pa.int64()) for i in range(len(NUMBERS))]]
            columns += [pa.array([t.audit for _, t in done], pa.string()), pa.array([t.hash.hexdigest() for _, t in done], pa.string())]
            if texts:
                columns.append(pa.array([[{"role": r, "text": x} for r, x in t.turns] for _, t in done], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))))
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            done = []
            order = batch.column(1).to_numpy()
            role, text, numbers = batch.column(2), batch.column(3), batch.column(4)
            for key, a, b in _runs(batch.column(0)):
                for i in range(a, b):
                    if order[i] == 0:
                        if now is not None:
                            done.append(now)
                        now = (key, _Text(numbers[i].as_py(), text[i].as_py(), texts))
                    else:
                        now[1].add(role[i].as_py(), text[i].as_py())
            yield finish(done)
        if now is not None:
            yield finish([now])

    dealt = first.unionByName(then).repartition("conv_id").sortWithinPartitions("conv_id", "order", "turn", "role", "digest").select("conv_id", "order", "role", "text", "numbers")
    schema = f"conv_id {kind}, {', '.join(f'{n} long' for n in NUMBERS)}, audit string, repaired_sha256 string" + (", repaired array<struct<role: string, text: string>>" if texts else "")
    return dealt.mapInArrow(run, schema)


ORACLE = r"""
WITH RECURSIVE byte_sums AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
places AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
sums AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(place, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM places, byte_sums),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM sums, range(CASE kind WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END)),
placed AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER w AS pos
           FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN pos > min(pos) OVER (PARTITION BY c, role, text) THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, substr(role, 1, 1) AS i FROM placed),
numbers AS (SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
            FROM (SELECT *, lag(i) OVER (PARTITION BY c ORDER BY pos) || i AS pair FROM faults) GROUP BY c),
-- states: a nothing yet, b after system, u after user, z after assistant; each the least (cost, audit, text)
steps AS (SELECT c, 0 AS pos, {'k': 0, 'a': '', 'o': ''} AS a, NULL::STRUCT(k INTEGER, a VARCHAR, o VARCHAR) AS b, {'k': 2, 'a': 'I', 'o': chr(10) || 'user:'} AS u, {'k': 4, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'} AS z FROM numbers
          UNION ALL
          SELECT c, pos, a, b, list_min(list_filter([u, {'k': a.k + 2, 'a': a.a || 'I', 'o': a.o || chr(10) || 'user:'}, CASE WHEN b IS NOT NULL THEN {'k': b.k + 2, 'a': b.a || 'I', 'o': b.o || chr(10) || 'user:'} END,
                                     {'k': z.k + 2, 'a': z.a || 'I', 'o': z.o || chr(10) || 'user:'}], lambda x: x IS NOT NULL AND x.k IS NOT NULL)) AS u,
                 list_min(list_filter([z, {'k': u.k + 2, 'a': u.a || 'I', 'o': u.o || chr(10) || 'assistant:'}, {'k': a.k + 4, 'a': a.a || 'II', 'o': a.o || chr(10) || 'user:' || chr(10) || 'assistant:'},
                                     CASE WHEN b IS NOT NULL THEN {'k': b.k + 4, 'a': b.a || 'II', 'o': b.o || chr(10) || 'user:' || chr(10) || 'assistant:'} END], lambda x: x IS NOT NULL AND x.k IS NOT NULL)) AS z
          FROM (SELECT c, pos, {'k': a.k + 3, 'a': a.a || 'D', 'o': a.o} AS a,
                       list_min(list_filter([CASE WHEN b IS NOT NULL THEN {'k': b.k + 3, 'a': b.a || 'D', 'o': b.o} END, CASE WHEN free AND i = 's' THEN {'k': a.k + more, 'a': a.a || 'K', 'o': a.o || kept} END], lambda x: x IS NOT NULL AND x.k IS NOT NULL)) AS b,
                       list_min(list_filter([{'k': u.k + 3, 'a': u.a || 'D', 'o': u.o}] || list_transform(CASE WHEN free THEN [a, b, z] ELSE [] END, lambda s: CASE WHEN s IS NOT NULL THEN CASE WHEN i = 'u' THEN {'k': s.k + more, 'a': s.a || 'K', 'o': s.o || kept} ELSE {'k': s.k + 2 + more, 'a': s.a || 'R', 'o': s.o || chr(10) || 'user:' || text} END END), lambda x: x IS NOT NULL AND x.k IS NOT NULL)) AS u,
                       list_min(list_filter([{'k': z.k + 3, 'a': z.a || 'D', 'o': z.o}] || list_transform(CASE WHEN free THEN [u] ELSE [] END, lambda s: CASE WHEN i = 'a' THEN {'k': s.k + more, 'a': s.a || 'K', 'o': s.o || kept} ELSE {'k': s.k + 2 + more, 'a': s.a || 'R', 'o': s.o || chr(10) || 'assistant:' || text} END), lambda x: x IS NOT NULL AND x.k IS NOT NULL)) AS z
                FROM (SELECT s.c, s.pos + 1 AS pos, a, b, u, z, f.fault IN ('', 'truncated') AS free, CASE WHEN f.fault = 'truncated' THEN 1 ELSE 0 END AS more, f.i, f.text, chr(10) || f.role || ':' || f.text AS kept
                      FROM steps s JOIN faults f ON f.c = s.c AND f.pos = s.pos + 1))),
best AS (SELECT c, list_min([a, z]) AS r FROM steps JOIN numbers USING (c) WHERE pos = n),
whole AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, r FROM numbers JOIN best USING (c)),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(r.k, 0) AS BIGINT) AS cost,
       coalesce(r.a, '') AS audit, sha256(substr(coalesce(r.o, ''), 2)) AS repaired_sha256
FROM ids LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM ids.conv_id"""
