"""Cheapest repair of conversations: roles in order, no blank, repeated or cut-off turns.

A dynamic programme goes through a conversation's rows with four states: nothing kept yet,
or the last kept role was system, user or assistant. Of each state it keeps the cheapest
audit (the edits' initials), of equally cheap ones the least by ASCII. Audits are linked
nodes that share their beginnings; a node knows its ancestors at powers of two and a rolling
hash of all its letters, so two audits of equal cost are compared by searching the length of
their common beginning. What equal hashes claim is then verified by walking both audits up to
a node they share.

Rows are streamed in order. As soon as all states' audits have a common beginning, the edits
in it are settled: the rows concerned are written and forgotten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: Added to every edit but a deletion of a row that breaks off.
CUT_OFF = 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state before a kept row, by the state after it.
BEFORE = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: From any state the rest costs at most this much more than from any other: two insertions.
AHEAD = 2 * COST[INSERT]
#: What separates words; a turn of nothing else is blank.
SPACES = " \t\n\x0b\x0c\r"
#: Rows and characters held before settled edits are looked for.
HELD_ROWS, HELD_CHARS = 4_096, 8_000_000


class Audits:
    """Strings as nodes of a tree: a node is its parent's string and one letter more."""

    def __init__(self, base: int = 0x5DEECE66D1CE4E5, modulus: int = (1 << 61) - 1):
        self.base, self.modulus = base, modulus
        self.parent, self.letter, self.depth, self.hash, self.jumps = [0], [""], [0], [0], [()]

    def add(self, parent: int, letter: str) -> int:
        node, jumps, at = len(self.parent), [parent], 0
        while len(self.jumps[jumps[at]]) > at:
            jumps.append(self.jumps[jumps[at]][at])
            at += 1
        self.parent.append(parent)
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self.base + ord(letter)) % self.modulus)
        self.jumps.append(tuple(jumps))
        return node

    def at_depth(self, node: int, depth: int) -> int:
        off = self.depth[node] - depth
        while off:
            node = self.jumps[node][off.bit_length() - 1]
            off = self.depth[node] - depth
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.at_depth(a, depth), self.at_depth(b, depth)
        differ = None
        if self.hash[x] != self.hash[y]:
            for j in reversed(range(len(self.jumps[x]))):
                if j < len(self.jumps[x]) and self.hash[self.jumps[x][j]] != self.hash[self.jumps[y][j]]:
                    x, y = self.jumps[x][j], self.jumps[y][j]
            differ = self.letter[x], self.letter[y]
            x, y = self.parent[x], self.parent[y]
        while x != y:  # equal by their hashes; a difference found here comes first
            if self.letter[x] != self.letter[y]:
                differ = self.letter[x], self.letter[y]
            x, y = self.parent[x], self.parent[y]
        return differ[0] < differ[1] if differ else self.depth[a] < self.depth[b]

    def text(self, node: int, above: int = 0) -> str:
        """The letters below the ancestor ``above``."""
        out = []
        while node != above:
            out.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(out))

    def shared(self, nodes: list[int]) -> int:
        """The lowest common ancestor; children have larger numbers than their parents."""
        left = set(nodes)
        while len(left) > 1:
            left.add(self.parent[last := max(left)])
            left.remove(last)
        return left.pop()


class Conversation:
    """One conversation's rows in order; ``out`` takes (edit, role, text) of settled edits."""

    def __init__(self, out, held_rows: int = HELD_ROWS, audits=Audits):
        self.out, self.limit, self.tree = out, held_rows, audits
        self.audits, self.live = audits(), {START: (0, 0)}
        self.rows: list[tuple[str, str]] = []
        self.chars, self.written, self.state, self.seen = 0, [], START, 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.first, self.turn, self.initial = 0, None, None, None
        self.live = self._inserted(self.live)

    def _best(self, offers: dict[int, list]) -> dict[int, tuple[int, int]]:
        """Of each state's offers (cost, parent, letter) the cheapest and then least, as a node."""
        done = {}
        for state, found in offers.items():
            least = min(o[0] for o in found)
            nodes = [p if letter is None else self.audits.add(p, letter) for c, p, letter in found if c == least]
            best = nodes[0]
            for node in nodes[1:]:
                best = node if self.audits.less(node, best) else best
            done[state] = (least, best)
        return done

    def _inserted(self, live: dict) -> dict:
        for state in (USER, ASSISTANT):
            offers = [(live[b][0] + COST[INSERT], live[b][1], INSERT) for b in BEFORE[state] if b in live]
            offers += [(*live[state], None)] if state in live else []
            live |= self._best({state: offers}) if offers else {}
        cheapest = min(c for c, _ in live.values())
        return {s: o for s, o in live.items() if o[0] <= cheapest + AHEAD}

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        truncated = truncated and not blank and not duplicate
        self.faults["blank"] += blank
        self.faults["duplicate"] += duplicate and not blank
        self.faults["truncated"] += truncated
        if self.seen:
            self.faults["illegal"] += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial, self.seen = role[:1], self.seen + 1
        if turn is not None:
            self.turns += turn != self.turn
            self.first = turn if self.first is None else self.first
            self.turn = turn

        offers = {s: [(c + COST[DELETE], node, DELETE)] for s, (c, node) in self.live.items()}
        if not blank and not duplicate:
            more = CUT_OFF if truncated else 0
            for state, before in BEFORE.items():
                kept = STATE_OF.get(role[:1]) == state
                for b in before:
                    if b in self.live and (kept or state in NAMES):
                        c, node = self.live[b]
                        edit = KEEP if kept else REROLE
                        offers.setdefault(state, []).append((c + COST[edit] + more, node, edit))
        self.live = self._inserted(self._best(offers))
        self.rows.append((role, text))
        self.chars += len(text)
        if len(self.rows) >= self.limit or self.chars >= HELD_CHARS:
            self._settle()

    def _settle(self) -> None:
        """Write what all states agree on and go on with a tree of the rest."""
        root = self.audits.shared([node for _, node in self.live.values()])
        self._write(self.audits.text(root))
        old, self.audits, new = self.audits, self.tree(), {root: 0}
        for state, (cost, node) in sorted(self.live.items(), key=lambda o: o[1][1]):
            for x in [old.at_depth(node, d) for d in range(old.depth[root] + 1, old.depth[node] + 1)]:
                new[x] = new[x] if x in new else self.audits.add(new[old.parent[x]], old.letter[x])
            self.live[state] = (cost, new[node])
        # what is left waits until as much has come again
        self.limit = max(self.limit, 2 * len(self.rows)) if self.rows else self.limit

    def _write(self, edits: str) -> None:
        at = 0
        for edit in edits:
            role, text = ("", "") if edit == INSERT else self.rows[at]
            at += edit != INSERT
            if edit == DELETE:
                self.out(edit, role, text)
                continue
            if edit != KEEP:
                role = NAMES[ASSISTANT if self.state == USER else USER]
            self.state = STATE_OF[role[:1]]
            self.out(edit, role, text)
        self.chars -= sum(len(t) for _, t in self.rows[:at])
        del self.rows[:at]
        self.written.append(edits)

    def end(self) -> dict:
        ends = [self.live[s] for s in (START, ASSISTANT) if s in self.live]
        cost, node = min(ends, key=lambda e: e[0])
        for c, other in ends:
            node = other if c == cost and self.audits.less(other, node) else node
        self._write(self.audits.text(node))
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        return {"gaps": gaps, **self.faults, "cost": cost, "audit": "".join(self.written)}


def _ordered(conversations: DataFrame, gone: Column | None) -> DataFrame:
    """Rows in order, equal ones as one with their number, with their faults."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)).alias("gone"),
    )
    absent = lambda c: F.when(~F.col("gone"), F.col(c)).alias(c)
    rows = rows.select("conv_id", absent("turn"), absent("role"), absent("text"), "gone")
    rows = rows.groupBy("conv_id", "turn", "role", "text", "gone").agg(F.count(F.lit(1)).alias("n"))
    said = F.rtrim("text", F.lit(SPACES))
    rows = rows.withColumn("blank", said == "").withColumn("cut_off", ~F.right(said, F.lit(1)).isin(".", "!", "?"))
    # both orders are within the conversations' partitions
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    rows = rows.repartition("conv_id").withColumn("seen", F.row_number().over(earlier) > 1)
    return rows.sortWithinPartitions("conv_id", F.desc("gone"), F.asc_nulls_first("turn"), "role", "text")


_SUMMARY = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _streamed(ordered: DataFrame, begin, finish, drain, schema: pa.Schema, held_rows: int) -> DataFrame:
    """``begin(conv)`` gives what takes a conversation's edits, ``finish`` ends it, ``drain`` gives rows to return."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, taker = None, None, None
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                for r in batch.slice(first, 256).to_pylist():
                    if now is None or r["conv_id"] != conv:
                        if now is not None:
                            finish(taker, now.end())
                        conv, taker = r["conv_id"], begin(r["conv_id"])
                        now = Conversation(taker, held_rows)
                    for copy in range(0 if r["gone"] else r["n"]):
                        now.add(r["turn"], r["role"], r["text"], r["blank"], r["seen"] or copy > 0, r["cut_off"])
                if rows := drain():
                    yield pa.RecordBatch.from_pylist(rows, schema)
        if now is not None:
            finish(taker, now.end())
        if rows := drain():
            yield pa.RecordBatch.from_pylist(rows, schema)

    names = {pa.int64(): "long", pa.string(): "string"}
    return ordered.mapInArrow(run, ", ".join(f"{f.name} {names[f.type]}" for f in schema))


class _Digest:
    def __init__(self, conv):
        self.conv, self.sha, self.begun = conv, hashlib.sha256(), False

    def __call__(self, edit: str, role: str, text: str) -> None:
        if edit != DELETE:
            self.sha.update(("\n" * self.begun + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.begun = True


def audits(conversations: DataFrame, gone: Column | None = None, held_rows: int = HELD_ROWS) -> DataFrame:
    """One row per conversation: ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``.

    Rows count by turn (nulls first), rows of one turn by role and text. A row's first fault counts:
    blank, role and text seen earlier in the conversation, or a text that does not end in ``.!?``.
    ``illegal`` counts neighbours whose roles' initials are none of su, ua, au; ``gaps`` the turns that
    are missing between the first and the last. ``audit`` is the cheapest edits' initials that leave
    ``(s?(ua)+)?``: Keep (0), Rerole (1), Delete (2, required for blank and duplicate rows), Insert of an
    empty user or assistant turn (5), 5 more for a kept row that breaks off; of equally cheap ones the
    least by ASCII. ``repaired_sha256`` is that of the repaired ``role:text`` lines.

    Null roles and texts count as one space, an empty role has no initial and is never kept, rows without a conversation id are one conversation.
    Repeated rows are duplicates, counted before they are shuffled. Rows for which ``gone`` is true do
    not exist, but their conversation does. An empty table gives an empty result. Other columns are not
    read. A conversation is one task, because its digest runs over all its text; the task streams it from
    a sort on disk and holds only the rows whose edits are not settled yet (all of them, if two repairs
    stay open to the end, as with nothing but user turns).
    """
    done: list[dict] = []

    def drain() -> list[dict]:
        out = done.copy()
        done.clear()
        return out

    def finish(taker: _Digest, summary: dict) -> None:
        done.append({"conv_id": taker.conv, **summary, "repaired_sha256": taker.sha.hexdigest()})

    return _streamed(_ordered(conversations, gone), _Digest, finish, drain, _SUMMARY, held_rows)


def repaired(conversations: DataFrame, gone: Column | None = None, held_rows: int = HELD_ROWS) -> DataFrame:
    """The repaired turns ``(conv_id, place, edit, role, text)``; see :func:`audits`. Deleted rows are not returned."""
    done: list[dict] = []

    def drain() -> list[dict]:
        out = done.copy()
        done.clear()
        return out

    def begin(conv):
        place = 0

        def take(edit: str, role: str, text: str) -> None:
            nonlocal place
            if edit != DELETE:
                done.append({"conv_id": conv, "place": place, "edit": edit, "role": role, "text": text})
                place += 1

        return take

    return _streamed(_ordered(conversations, gone), begin, lambda *_: None, drain, _TURNS, held_rows)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text, gone)`` damaged by crc32(``conv_id:turn``) % 20.

    0 drops a row (``gone``), 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it a
    user's. Null roles and texts, and null ids and turns in the checksum, are one space.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).alias("code")
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), code)
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.col("code") == 0, F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("gone"))
