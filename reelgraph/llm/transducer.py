"""A BPE vocabulary compiled into a deterministic transducer, as far as the texts need it.

Byte-pair encoding has a local test: a sequence of tokens is the encoding of its text exactly if each
two neighbours are the encoding of the text of the two.  Read from left to right, the encoding of a
prefix therefore ends in the one token that fits behind the encoding of the shorter prefix before it.
What later symbols need of the past is finite: for each place at which a token that is still open may
have begun, the token that ends there.  That is a state; a transition is annotated with the token that
ends the prefix, and with the change of the number of tokens, which is negative where tokens merge.

States are made when a text first reaches them, by any worker for itself.  Most have one transition,
which stands beside the state; only states that branch have a row over all symbols.  When tables and
keys take more than ``MOST_BYTES``, also in the middle of a text, the states that were not used for the
longest time are dropped, about half of all, so a worker's memory has a bound whatever it reads.

Texts are cut into chunks, and chunks advance side by side.  A chunk inside a word has a state map: the
exits and counts of the states it may be entered in, guessed by reading a few symbols before it.  Maps
are composed pairwise in a tree; where an exit is no guessed entry, the map behind it is extended.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np

#: Estimated bytes of states and transitions that a worker keeps.
MOST_BYTES = 80 << 20
#: Tests of neighbouring tokens that are remembered.
MOST_FITS = 50_000
#: Symbols of a chunk.
CHUNK = 512
#: Symbols before a chunk from which its entry states are guessed.
WARM = (64, 16)
STATE_BYTES, NONE = 220, -1
#: Of how many steps one marks the states that it meets as used; frequent states are met by many lanes.
MARK_STEPS = 8


def _pack(node: int, token: int, count: int) -> int:
    return node << 40 | (token + 1) << 12 | (count + 2048)


START = array("q", (_pack(0, -1, 0),)).tobytes()


class Transducer:
    """States over symbols; a symbol is the vocabulary's id of a single character or byte.

    ``merge(a, b)`` gives the order and the result of joining two tokens, or None.  ``spelled`` maps a
    token to its symbols.  Symbols in ``final`` end a word: the next state is the start.  ``built`` has the
    order and parts of tokens that only one join can build.
    """

    def __init__(self, merge: Callable[[int, int], tuple[int, int] | None], spelled: dict[int, tuple[int, ...]], final: frozenset[int] = frozenset(), built: dict[int, tuple[float, int, int]] | None = None):
        self.merge, self.spelled, self.final, self.built = merge, spelled, final, built or {}
        self.children: dict[int, int] = {}
        token_at, is_open = array("i", (-1,)), bytearray(1)
        for token, symbols in spelled.items():
            node = 0
            for s in symbols:
                is_open[node] = 1
                key = node << 20 | s
                following = self.children.get(key)
                if following is None:
                    following = self.children[key] = len(token_at)
                    token_at.append(-1)
                    is_open.append(0)
                node = following
            token_at[node] = token
        self.token_at, self.open = token_at, is_open
        self.column: dict[int, int] = {}
        self.symbol_of: list[int] = []
        size = max(spelled) + 1
        self.length = np.zeros(size, np.int32)
        for token, symbols in spelled.items():
            self.length[token] = len(symbols)
        #: The last join that builds a token from its symbols: parts and level; -2 if not looked at, -1 if none.
        self.left, self.right = array("i", [-2]) * size, array("i", [-1]) * size
        self.level = array("d", [0.0]) * size
        self.fits: dict[int, bool] = {}
        self.columns = 64
        self.filled = 0
        self._clear()

    def _clear(self) -> None:
        self.states: list[bytes | None] = [START]
        self.number = {START: 0}
        self.final_state: dict[int, int] = {}
        self.first_symbol, self.first_value, self.row, self.token, self.used = (np.full(4096, v, np.int32) for v in (NONE, NONE, 0, 0, 0))
        self.rows, self.size, self.clock = 1, 0, 0
        self.branches = np.full(64 * self.columns, NONE, np.int32)

    def columns_of(self, symbols: np.ndarray) -> np.ndarray:
        """The column of each of a few symbols in the rows of branching states; new ones are added."""
        for s in symbols.tolist():
            if s not in self.column:
                self.column[s] = len(self.symbol_of)
                self.symbol_of.append(s)
        if len(self.symbol_of) > self.columns:
            was, self.columns = self.columns, len(self.symbol_of) + 32
            wide = np.full((len(self.branches) // was, self.columns), NONE, np.int32)
            wide[:, :was] = self.branches.reshape(-1, was)
            self.branches = wide.reshape(-1)
            self.size += 4 * self.rows * (self.columns - was)
        return np.array([self.column[s] for s in symbols.tolist()], np.int32)

    def encode_symbols(self, symbols: tuple[int, ...], joins: list | None = None) -> list[int]:
        """Plain byte-pair encoding: the first of the best pairs is joined until none is left."""
        row = list(symbols)
        while True:
            best = None
            for i in range(len(row) - 1):
                found = self.merge(row[i], row[i + 1])
                if found and (best is None or found[0] < best[0]):
                    best = found[0], i, found[1]
            if best is None:
                return row
            if joins is not None:
                joins.append((best[0], row[best[1]], row[best[1] + 1], best[2]))
            row[best[1] : best[1] + 2] = [best[2]]

    def _parts(self, token: int) -> bool:
        """Find how a token is built; False if the encoder does not build it from its symbols."""
        if self.left[token] == -2:
            once = self.built.get(token)
            if once and (fits := self._parts(once[1]) and self._parts(once[2]) and self._edge(once[1], once[2], True)) is not None:
                self.left[token], self.level[token] = -1, np.inf
                if fits:
                    order, self.left[token], self.right[token] = once
                    self.level[token] = max(order, self.level[once[1]], self.level[once[2]])
                return fits
            joins: list = []
            whole = self.encode_symbols(self.spelled[token], joins) == [token]
            self.left[token], self.level[token] = -1, -1.0 if whole else np.inf
            if whole and joins:
                order, self.left[token], self.right[token], _ = joins[-1]
                self._parts(joins[-1][1]), self._parts(joins[-1][2])
                self.level[token] = max(order, self.level[joins[-1][1]], self.level[joins[-1][2]])
        return self.level[token] != np.inf

    def fit(self, a: int, b: int) -> bool:
        """Are the two tokens the encoding of their text?

        Both are taken apart from the last join to the first along their common edge; a join across the
        edge that would come before the join that ends its two parts shows that they are not.
        """
        if a < 0:
            return self.level[b] != np.inf if self.left[b] != -2 else self._parts(b)
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > MOST_FITS:
                self.fits.clear()
            known = self._parts(b) and self._parts(a) and self._edge(a, b)
            if known is None:
                known = self.encode_symbols(self.spelled[a] + self.spelled[b]) == [a, b]
            self.fits[key] = known
        return known

    def _edge(self, a: int, b: int, joining: bool = False) -> bool | None:
        """No join across the edge comes too early; but for the two tokens' own if they are ``joining``.  None: undecided."""
        x, y, until, merge, level = a, b, np.inf, self.merge, self.level
        while True:
            found = None if joining else merge(x, y)
            joining = False
            high_x, high_y = level[x], level[y]
            if found:
                comes = max(found[0], high_x, high_y)
                if comes < until:
                    return False
                if comes == until:  # the place decides
                    return None
            if high_x < 0 and high_y < 0:
                return True
            if high_x == high_y:
                return None
            if high_x > high_y:
                until, x = high_x, self.right[x]
            else:
                until, y = high_y, self.left[y]

    def _new_state(self, key: bytes | None, token: int) -> int:
        number = len(self.states)
        self.states.append(key)
        self.size += STATE_BYTES + len(key or b"")
        if number >= len(self.token):
            for name, fill in (("first_symbol", NONE), ("first_value", NONE), ("row", 0), ("token", 0), ("used", 0)):
                was = getattr(self, name)
                setattr(self, name, np.concatenate((was, np.full(len(was) // 2, fill, np.int32))))
        self.token[number], self.used[number] = token, self.clock
        return number

    def intern(self, key: bytes) -> int:
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = self._new_state(key, (array("q", key)[-1] >> 12 & 0xFFFFFFF) - 1)
        return number

    def _fill(self, state: int, column: int) -> None:
        symbol = self.symbol_of[column]
        children, token_at, is_open = self.children, self.token_at, self.open
        token, change, moved = -1, 0, []
        for item in array("q", self.states[state]):
            child = children.get(item >> 40 << 20 | symbol)
            if child is None:
                continue
            if is_open[child]:
                moved.append(child << 40 | item & 0xFFFFFFFFFF)
            if token < 0 and (here := token_at[child]) >= 0 and self.fit((item >> 12 & 0xFFFFFFF) - 1, here):
                token, change = here, (item & 0xFFF) - 2047
        if token < 0:
            raise ValueError(f"no token ends at symbol {symbol}")
        if symbol in self.final:  # nothing follows; the token alone tells such states apart
            number = self.final_state.get(token)
            if number is None:
                number = self.final_state[token] = self._new_state(None, token)
        else:
            moved = [m - change for m in moved]  # counts are relative to the last token's
            moved.append(token + 1 << 12 | 2048)
            key = array("q", moved).tobytes()
            number = self.number.get(key)
            if number is None:
                number = self.number[key] = self._new_state(key, token)
        value = number << 8 | change + 128
        self.filled += 1
        if self.first_symbol[state] == NONE:
            self.first_symbol[state], self.first_value[state] = column, value
            return
        if not self.row[state]:
            if (self.rows + 1) * self.columns > len(self.branches):
                self.branches = np.concatenate((self.branches, np.full((self.rows // 2 + 1) * self.columns, NONE, np.int32)))
            self.row[state] = self.rows
            self.rows += 1
            self.size += 4 * self.columns
        self.branches[int(self.row[state]) * self.columns + column] = value

    def _renew(self, states: np.ndarray) -> np.ndarray:
        """Drop the states that were not used for the longest time, but not those given; the new numbers of these."""
        n = len(self.states)
        used = self.used[:n]
        keep = used > np.partition(used, n // 2)[n // 2]
        keep[0] = True
        keep[states] = True
        number = np.where(keep, np.cumsum(keep) - 1, NONE).astype(np.int32)
        key, final = [], {v: k for k, v in self.final_state.items()}
        for s in np.flatnonzero(keep).tolist():
            key.append(self.states[s])
        self.final_state = {t: int(number[s]) for s, t in final.items() if keep[s]}
        self.states, self.number = key, {k: i for i, k in enumerate(key) if k is not None}

        def moved(value: np.ndarray) -> np.ndarray:
            to = np.where(value < 0, NONE, number[np.maximum(value, 0) >> 8])
            return np.where(to < 0, NONE, to << 8 | value & 255).astype(np.int32)

        row = self.row[:n][keep]
        held = np.flatnonzero(row)
        cells = moved(self.branches.reshape(-1, self.columns)[np.concatenate(([0], row[held]))].reshape(-1))
        self.rows = len(held) + 1
        self.branches = np.concatenate((cells, np.full((self.rows // 2 + 1) * self.columns, NONE, np.int32)))
        row[held] = np.arange(1, self.rows)
        value = moved(self.first_value[:n][keep])
        symbol = np.where(value < 0, NONE, self.first_symbol[:n][keep]).astype(np.int32)
        spare = max(4096, len(key) // 2)
        for name, kept, fill in (("first_symbol", symbol, NONE), ("first_value", value, NONE), ("row", row, 0), ("token", self.token[:n][keep], 0), ("used", used[keep], 0)):
            setattr(self, name, np.concatenate((kept, np.full(spare, fill, np.int32))))
        self.size = sum(STATE_BYTES + len(k or b"") for k in key) + 4 * self.rows * self.columns
        return number[states]

    def _values(self, states: np.ndarray, columns: np.ndarray) -> np.ndarray:
        value = self.first_value.take(states)
        other = np.flatnonzero(self.first_symbol.take(states) != columns)
        if len(other):
            value[other] = self.branches.take(self.row.take(states[other]) * self.columns + columns[other])
        return value

    def keys(self, states: np.ndarray) -> list[bytes]:
        """Names of states that stay valid when tables are dropped."""
        return [self.states[s] for s in states.tolist()]

    def sweep(self, columns: np.ndarray, word_end: np.ndarray, starts: np.ndarray, stops: np.ndarray, entry: list[bytes] | None = None, trace: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray]:
        """Advance through segments of a text side by side; exit states and changes of the count.

        Without entries all begin at the start.  ``trace`` gets the token that ends the prefix at each place.
        """
        n = len(starts)
        if not n:
            return [], np.zeros(0, np.int64)
        self.clock += 1
        order = np.argsort(starts - stops, kind="stable")  # the longest first: those that go on are a prefix
        begin, sizes = starts[order].tolist(), (stops - starts)[order]
        longest = int(sizes[0])
        now = np.zeros(n, np.int32) if entry is None else np.array([self.intern(entry[i]) for i in order.tolist()], np.int32)
        # one row for each step, so that a step reads and writes neighbouring cells
        symbols, going = np.zeros((n, longest), columns.dtype), np.zeros((n, longest), bool)
        for row, (b, size) in enumerate(zip(begin, sizes.tolist())):
            symbols[row, :size] = columns[b : b + size]
            going[row, :size] = word_end[b : b + size]
        symbols, going = np.ascontiguousarray(symbols.T), np.ascontiguousarray(~going.T)
        passed = np.zeros((longest, n), np.int32) if trace is not None else None
        sums = np.zeros(n, np.int64)
        for t, alive in enumerate(np.searchsorted(-sizes, -np.arange(longest), "left").tolist()):
            here, symbol, renewed = now[:alive], symbols[t, :alive], False
            value = self._values(here, symbol)
            while value.min() < 0:
                if self.size > MOST_BYTES and not renewed:
                    now, renewed = self._renew(now), True
                    here = now[:alive]
                else:
                    missing = np.flatnonzero(value < 0)
                    for k in np.unique(here[missing].astype(np.int64) << 20 | symbol[missing]).tolist():
                        self._fill(k >> 20, k & 0xFFFFF)
                value = self._values(here, symbol)
            to = value >> 8
            if not t % MARK_STEPS:
                self.used[to] = self.clock
            if passed is not None:
                passed[t, :alive] = self.token.take(to)
            else:
                sums[:alive] += value & 255
            np.multiply(to, going[t, :alive], out=here)
        if passed is not None:
            across = np.ascontiguousarray(passed.T)
            for row, (b, size) in enumerate(zip(begin, sizes.tolist())):
                trace[b : b + size] = across[row, :size]
        changes, exits = np.empty(n, np.int64), [b""] * n
        changes[order] = sums - 128 * sizes
        for i, key in zip(order.tolist(), self.keys(now)):
            exits[i] = key
        return exits, changes

    def guesses(self, columns: np.ndarray, word_end: np.ndarray, lo: np.ndarray) -> list[list[bytes]]:
        """States in which places may be entered: the start behind a word's end, else guessed from both lengths."""
        first = np.concatenate(([0], np.flatnonzero(word_end) + 1))
        word = first[np.searchsorted(first, lo, "right") - 1]
        out: list[list[bytes]] = [[START] for _ in range(len(lo))]
        for warm in WARM:
            need = np.flatnonzero((lo > word) & ((warm == WARM[0]) | (lo - word > warm)))
            found, _ = self.sweep(columns, word_end, np.maximum(word[need], lo[need] - warm), lo[need])
            for i, key in zip(need.tolist(), found):
                if warm == WARM[0]:
                    out[i] = [key]
                elif key not in out[i]:
                    out[i].append(key)
        return out

    def counts(self, columns: np.ndarray, word_end: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Numbers of tokens of texts, by state maps of their chunks composed in a tree."""
        pieces = np.maximum(1, -(-(stops - begins) // CHUNK))
        text = np.repeat(np.arange(len(begins)), pieces)
        within = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo = begins[text] + within * CHUNK
        hi = np.minimum(lo + CHUNK, stops[text])
        entries = self.guesses(columns, word_end, lo)
        maps: list[dict[bytes, tuple[bytes, int]]] = [{} for _ in range(len(lo))]

        def measure(asked: list[tuple[int, bytes]]) -> None:
            at = np.array([i for i, _ in asked], np.int64)
            exits, changes = self.sweep(columns, word_end, lo[at], hi[at], [e for _, e in asked])
            for (i, e), x, c in zip(asked, exits, changes.tolist()):
                maps[i][e] = x, c

        measure([(i, e) for i, es in enumerate(entries) for e in es])

        def extend(asked: list[tuple[int, int, bytes]]) -> list[tuple[bytes, int]]:
            """Exits and changes of runs of chunks for states that their maps do not hold yet."""
            place, state, total = [a for a, _, _ in asked], [e for _, _, e in asked], [0] * len(asked)
            while True:
                lacking: dict[tuple[int, bytes], None] = {}
                for k, (_, end, _) in enumerate(asked):
                    while place[k] < end and (got := maps[place[k]].get(state[k])):
                        state[k], total[k], place[k] = got[0], total[k] + got[1], place[k] + 1
                    if place[k] < end:
                        lacking[place[k], state[k]] = None
                if not lacking:
                    return list(zip(state, total))
                measure(list(lacking))

        # nodes of the tree: text, first chunk, end, map of the run of chunks
        nodes = [(t, i, i + 1, maps[i]) for i, t in enumerate(text.tolist())]
        while len(nodes) > len(begins):
            pairs, k, level = [], 0, []
            while k < len(nodes):
                if k + 1 < len(nodes) and nodes[k][0] == nodes[k + 1][0]:
                    pairs.append((len(level), nodes[k], nodes[k + 1]))
                    level.append(None)
                    k += 2
                else:
                    level.append(nodes[k])
                    k += 1
            unknown = [(b, x) for _, a, b in pairs for x in {x for x, _ in a[3].values()} if x not in b[3]]
            if unknown:
                for (b, x), got in zip(unknown, extend([(b[1], b[2], x) for b, x in unknown])):
                    b[3][x] = got
            for slot, a, b in pairs:
                level[slot] = a[0], a[1], b[2], {e: (b[3][x][0], c + b[3][x][1]) for e, (x, c) in a[3].items()}
            nodes = level
        return np.array([m[START][1] for _, _, _, m in nodes], np.int64)

    def tokens(self, columns: np.ndarray, word_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words of a text, and the place of each one's last symbol.

        ``word_end`` marks the last symbol of each word; the state is the start behind it.
        """
        n = len(columns)
        if not n:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        lo = np.arange(0, n, CHUNK)
        hi = np.append(lo[1:], n)
        trace = np.empty(n, np.int32)
        entry = [e[0] for e in self.guesses(columns, word_end, lo)]
        exits, _ = self.sweep(columns, word_end, lo, hi, entry, trace)
        wrong = [i for i in range(1, len(lo)) if exits[i - 1] != entry[i]]
        while wrong:  # chunks that were entered in another state than guessed
            for i in wrong:
                entry[i] = exits[i - 1]
            at = np.array(wrong, np.int64)
            for i, key in zip(wrong, self.sweep(columns, word_end, lo[at], hi[at], [entry[i] for i in wrong], trace)[0]):
                exits[i] = key
            wrong = [i + 1 for i in wrong if i + 1 < len(lo) and exits[i] != entry[i + 1]]
        width = self.length[trace]
        mark = np.zeros(n, bool)
        at = np.flatnonzero(word_end)
        begin = np.concatenate(([0], at[:-1] + 1))
        while len(at):
            mark[at] = True
            at = at - width[at]
            on = at >= begin
            at, begin = at[on], begin[on]
        places = np.flatnonzero(mark)
        return trace[places], places

    def widens(self, columns: np.ndarray, lo: int, hi: int) -> bool:
        """Does a stretch inside a word lead to another state at more than a quarter of its symbols?"""
        key, met = START, set()
        for column in columns[lo:hi].tolist():
            state = self.intern(key)
            value = int(self._values(np.array([state]), np.array([column]))[0])
            if value < 0:
                self._fill(state, column)
                value = int(self._values(np.array([state]), np.array([column]))[0])
            key = self.states[value >> 8]
            met.add(key)
        return 4 * len(met) > hi - lo
