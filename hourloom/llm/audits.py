"""Edit scripts as persistent linked nodes, and the cheapest script of a conversation."""

from __future__ import annotations

BASE, MODULUS = 257, (1 << 61) - 1

# States of a repaired conversation: nothing yet, after a system turn, after a user turn, after
# an assistant turn. It may end in the first and the last.
EMPTY, SYSTEM, USER, ASSISTANT = STATES = range(4)
ENDS = (EMPTY, ASSISTANT)
#: Where a kept row of each initial leads from each state.
MOVES = {
    "s": {EMPTY: SYSTEM},
    "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
#: Where a new turn leads from each state; the role it must have follows from it.
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL_PAIRS = {"su", "ua", "au"}

# Costs and letters of the edits; ties go to the script that is least in ASCII.
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3

# Faults of a row.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


class Script:
    """A script: its parent's letters and then `text`. Scripts share their beginnings; each
    node knows its ancestors 1, 2, 4, ... steps up, and a rolling hash of all its letters."""

    __slots__ = ("text", "length", "depth", "hash", "up")

    def __init__(self, parent: Script | None, text: str):
        self.text = text
        if parent is None:
            self.length = self.depth = self.hash = 0
            self.up: list[Script] = []
            return
        self.length = parent.length + len(text)
        self.depth = parent.depth + 1
        h = parent.hash
        for c in text:
            h = (h * BASE + ord(c)) % MODULUS
        self.hash = h
        self.up = up = [parent]
        k = 0
        while len(up[k].up) > k:
            up.append(up[k].up[k])
            k += 1

    def lifted(self, depth: int) -> Script:
        """The ancestor at a depth."""
        node = self
        while node.depth > depth:
            node = node.up[(node.depth - depth).bit_length() - 1]
        return node

    def tail(self, above: Script | None) -> str:
        """The letters after an ancestor (None: all)."""
        parts, node = [], self
        while node is not above and node.up:
            parts.append(node.text)
            node = node.up[0]
        return "".join(reversed(parts))


ROOT = Script(None, "")


def _alike(a: Script, b: Script) -> bool:
    return a is b or (a.hash == b.hash and a.length == b.length)


def _equal(a: Script, b: Script) -> bool:
    """Whether two scripts with equal hashes are equal, letter by letter up to the first node
    they share."""
    while a is not b:
        if a.text != b.text:
            return False
        if not a.up or not b.up:
            return not a.up and not b.up
        a, b = a.up[0], b.up[0]
    return True


def less(a: Script, b: Script) -> bool:
    """Whether script a comes before b. Their longest common beginning is searched by lifting
    both over nodes whose hashes differ, and verified; letters after it decide."""
    if a is b:
        return False
    depth = min(a.depth, b.depth)
    x, y = a.lifted(depth), b.lifted(depth)
    if not _alike(x, y):
        for k in range(len(x.up) - 1, -1, -1):
            if k < len(x.up) and not _alike(x.up[k], y.up[k]):
                x, y = x.up[k], y.up[k]
        x, y = x.up[0], y.up[0]
    if not _equal(x, y):
        x = y = None  # a collision, or letters dealt out otherwise: compare all
    return a.tail(x) < b.tail(y)


Best = tuple[int, Script] | None


def better(now: Best, cost: int, parent: Script, letters: str) -> tuple[int, Script]:
    """The cheaper one of a script and of `parent` with `letters` added at `cost`."""
    if now is not None:
        if now[0] < cost:
            return now
        if now[0] == cost:
            script = Script(parent, letters)
            return (cost, script) if less(script, now[1]) else now
    return cost, Script(parent, letters)


def with_inserts(best: list[Best]) -> list[Best]:
    """The same after any new turns that pay: at most one of each role."""
    for source in (EMPTY, SYSTEM, ASSISTANT, USER):
        if best[source] is not None:
            cost, script = best[source]
            target = NEXT[source]
            best[target] = better(best[target], cost + INSERT_COST, script, INSERT)
    return best


def after_row(best: list[Best], initial: str, fault: int, copies: int) -> list[Best]:
    """Best scripts after a row that occurs `copies` times in a row, from those before it.

    At equal cost no script is the beginning of another one (what is added would be inserts,
    which cost), so the best beginnings make the best scripts. Copies after the first are
    duplicates. Deletes come before inserts in ASCII, so no insert goes between them.
    """
    new: list[Best] = [None] * 4
    forced = copies if fault in (BLANK, DUPLICATE) else copies - 1
    for state in STATES:
        if best[state] is None:
            continue
        cost, script = best[state]
        if forced == copies:
            new[state] = better(new[state], cost + DELETE_COST * copies, script, DELETE * copies)
            continue
        rest, more = DELETE * forced, DELETE_COST * forced
        stays = cost + more + TRUNCATED_COST * (fault == TRUNCATED)
        target = MOVES.get(initial, {}).get(state)
        if target is not None:
            new[target] = better(new[target], stays, script, KEEP + rest)
        target = NEXT[state]
        new[target] = better(new[target], stays + REROLE_COST, script, REROLE + rest)
        new[state] = better(new[state], cost + more + DELETE_COST, script, DELETE + rest)
    return with_inserts(new)


def beginning() -> list[Best]:
    return with_inserts([(0, ROOT), None, None, None])


def cheapest(best: list[Best]) -> tuple[int, str]:
    """(cost, letters) of the best script that ends a conversation."""
    found: Best = None
    for state in ENDS:
        if best[state] is not None:
            cost, script = best[state]
            found = better(found, cost, script, "")
    return found[0], found[1].tail(None)


class Piece:
    """What a stretch of a conversation's rows does: counts, and the best script from each
    state it may be entered in to each state it may be left in. Pieces of one conversation
    compose, so a long one is worked on in many tasks. `begins`: it is known that no row of
    the conversation comes before, so it is entered in one way only."""

    def __init__(self, begins: bool):
        self.begins = begins
        self.rows = 0
        self.counts = [0, 0, 0, 0]
        self.illegal = 0
        self.first = self.last = None
        entries = [[None] * 4 for _ in STATES]
        for state in STATES:
            entries[state][state] = (0, ROOT)
        self.paths = [beginning()] if begins else entries

    def add(self, initial: str, fault: int, copies: int) -> None:
        self.rows += 1
        if fault in (BLANK, DUPLICATE):
            self.counts[fault] += copies
        else:
            self.counts[fault] += 1
            self.counts[DUPLICATE] += copies - 1
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL_PAIRS
        self.illegal += copies - 1  # an initial next to itself is never legal
        self.last = initial
        self.paths = [after_row(best, initial, fault, copies) for best in self.paths]

    def costs(self) -> list[int | None]:
        return [b and b[0] for best in self.paths for b in best]

    def scripts(self) -> list[str | None]:
        return [b and b[1].tail(None) for best in self.paths for b in best]


def composed(best: list[Best], costs: list[int | None], scripts: list[str | None]) -> list[Best]:
    """Best scripts after a piece, from those before it. Each piece's letters are one node."""
    if len(costs) == len(STATES):
        return [None if c is None else (c, Script(ROOT, s)) for c, s in zip(costs, scripts)]
    new: list[Best] = [None] * 4
    for i, (c, s) in enumerate(zip(costs, scripts)):
        source, target = divmod(i, len(STATES))
        if c is not None and best[source] is not None:
            cost, script = best[source]
            new[target] = better(new[target], cost + c, script, s)
    return new
