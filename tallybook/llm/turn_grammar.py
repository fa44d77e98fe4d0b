"""The cheapest repair of a sequence of turns, over a Re-Pair grammar with min-plus matrices.

Every turn is a symbol: the initial of its role and whether it must go or is cut short.
Re-Pair (Larsson and Moffat 1999) replaces frequent neighbours by a rule, and rules of
rules. A rule's transfer matrix holds, for each pair of states of the role pattern
`(s?(ua)+)?`, the least cost of any edits of its turns between them, and the audit of these
edits as a rope: a tuple of the ropes of its two halves. Matrices come bottom-up, one
min-plus product a rule, and serve all conversations.

An audit is one letter an edit: Keep, Rerole, Delete, Insert. The pattern leaves no choice
of roles once the letters are known, so a state and a letter give the next state. An audit
that goes on with further letters costs more for each Insert, so of two audits of one cost
over the same turns neither starts the other, and the least of each part is part of the
least whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cmp_to_key

#: States of the pattern: start, after system, after user, after assistant. Ends: EMPTY and ASSISTANT.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = (EMPTY, SYSTEM, USER, ASSISTANT)
ENDS = (EMPTY, ASSISTANT)
#: Costs of the edits and of a kept turn that is cut short; fixed by the result contract.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
NEVER = 1 << 40

#: Symbols of turns: must go, then each role sound and cut short. `o` is any other role.
GONE = "-"
SOUND = {"s": "s", "u": "u", "a": "a", "o": "o"}
SHORT = {"s": "S", "u": "U", "a": "A", "o": "O"}
TERMINALS = [GONE, *SOUND.values(), *SHORT.values()]

Rope = tuple | str
Entry = tuple[int, Rope]
Matrix = list[list[Entry]]


def step(state: int, role: str) -> int | None:
    """The state after a turn of that role, if the pattern allows it."""
    if role == "s":
        return SYSTEM if state == EMPTY else None
    if role == "u":
        return USER if state != USER else None
    if role == "a":
        return ASSISTANT if state == USER else None
    return None


def flat(rope: Rope) -> str:
    """The letters of a rope; its depth is no matter."""
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack += [top[1], top[0]]
    return "".join(out)


def better(a: Entry, b: Entry) -> Entry:
    """Lower cost, then the audit that comes first."""
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[0] >= NEVER or a[1] is b[1] or flat(a[1]) <= flat(b[1]) else b


def _insertions() -> Matrix:
    """Insertions alone: never more than two in a row, as a third only leads back."""
    found = [[(0, "") if p == q else (NEVER, "") for q in STATES] for p in STATES]
    for p in STATES:
        at, letters = p, ""
        for n in (1, 2):
            at = step(at, "a" if at == USER else "u")
            letters += "I"
            found[p][at] = better((n * INSERT, letters), found[p][at])
    return found


INSERTIONS = _insertions()


def _edits(symbol: str) -> Matrix:
    """One edit of one turn."""
    found = [[(NEVER, "")] * len(STATES) for _ in STATES]
    role, cut = symbol.lower(), CUT if symbol.isupper() else 0
    for p in STATES:
        found[p][p] = (DELETE, "D")
        if symbol != GONE:
            for to, cost, letter in ((role, cut, "K"), ("u", REROLE + cut, "R"), ("a", REROLE + cut, "R")):
                q = step(p, to)
                if q is not None:
                    found[p][q] = better((cost, letter), found[p][q])
    return found


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; the audit of an entry is the rope of its halves."""
    out = []
    for row in a:
        line = []
        for q in STATES:
            best: Entry = (NEVER, "")
            for m in STATES:
                cost = row[m][0] + b[m][q][0]
                if cost < NEVER and cost <= best[0]:
                    best = better((cost, (row[m][1], b[m][q][1])), best)
            line.append(best)
        out.append(line)
    return out


class Grammar:
    """Rules in the order they were made: (symbol, the pair that it stands for)."""

    def __init__(self, rules: Iterable[tuple[str, str]] = ()):
        self.rules = list(rules)
        self.matrices = {s: product(INSERTIONS, _edits(s)) for s in TERMINALS}
        for symbol, pair in self.rules:
            self.matrices[symbol] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def compressed(self, turns: str) -> str:
        for symbol, pair in self.rules:
            if len(turns) < 2:
                break
            turns = turns.replace(pair, symbol)
        return turns

    def matrix(self, turns: str) -> Matrix:
        """Of a block of turns. All that is left uncompressed is multiplied in pairs."""
        parts = [self.matrices[s] for s in self.compressed(turns)]
        while len(parts) > 1:
            pairs = [product(a, b) for a, b in zip(parts[::2], parts[1::2], strict=False)]
            parts = pairs + parts[len(pairs) * 2 :]
        return parts[0]


def before(matrix: Matrix, ahead: list[int]) -> list[int]:
    """Cost to go from each state before a block, given that after it."""
    return [min(min(matrix[p][q][0] + ahead[q] for q in STATES), NEVER) for p in STATES]


def at_end() -> list[int]:
    """Cost to go after the last turn: insertions up to an end."""
    return [min(INSERTIONS[p][q][0] for q in ENDS) for p in STATES]


def chosen(matrix: Matrix, state: int, ahead: list[int]) -> tuple[str, int]:
    """(audit, state after) of the best way through a block."""
    ways = [(matrix[state][q][0] + ahead[q], q) for q in STATES]
    least = min(ways)[0]
    return min((flat(matrix[state][q][1]), q) for cost, q in ways if cost == least)


def closing(state: int) -> tuple[str, int]:
    """(audit, cost) of the insertions after the last turn."""
    cost, audit = min((INSERTIONS[state][q][0], flat(INSERTIONS[state][q][1])) for q in ENDS)
    return audit, cost


def applied(audit: str, state: int, turns: Iterable[tuple[str, str]]) -> tuple[list[tuple[str, str]], int]:
    """The turns (role, text) that edits leave, from a state on, and the state after."""
    rest, out = iter(turns), []
    for letter in audit:
        if letter == "I":
            role, text = ("assistant" if state == USER else "user"), ""
        else:
            role, text = next(rest)
            if letter == "D":
                continue
            if letter == "R":
                role = "assistant" if state == USER else "user"
        out.append((role, text))
        state = step(state, role[:1])
    return out, state


def new_rules(counts: list[tuple[str, int]], used: set[str], room: int) -> list[tuple[str, str]]:
    """Rules for the most frequent pairs of which no two share a symbol, so their order is no matter."""
    rules: list[tuple[str, str]] = []
    busy: set[str] = set()
    code = 0x100 + len(used)
    for pair, count in sorted(counts, key=cmp_to_key(lambda a, b: b[1] - a[1] or (1 if a[0] > b[0] else -1))):
        if count < 2 or len(rules) >= room:
            break
        if not busy & set(pair):
            rules.append((chr(code + len(rules)), pair))
            busy |= set(pair)
    return rules


PairCount = Callable[[list[tuple[str, str]]], list[tuple[str, int]]]


def re_pair(count_pairs: PairCount, most: int, rounds: int) -> Grammar:
    """A grammar of at most `most` rules. count_pairs(rules) counts neighbours once the rules are applied."""
    rules: list[tuple[str, str]] = []
    for _ in range(rounds):
        fresh = new_rules(count_pairs(rules), {s for s, _ in rules}, most - len(rules))
        if not fresh:
            break
        rules += fresh
    return Grammar(rules)
