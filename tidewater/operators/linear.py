"""Small linear programmes in exact rationals: what one portfolio or one group of constraints needs, inside its own task."""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm


class Unproven(Exception):
    """The search ended before its answer was known to be the best."""


class Simplex:
    """a x = b with 0 <= x <= upper (None: without bound), by Bland's rule, so that it always ends.

    optimise() may be called for one cost after the other: each keeps to the best points of those before it."""

    def __init__(self, a: list[list[Fraction]], b: list[Fraction], upper: list[Fraction | None]):
        m, self.n = len(a), len(upper)
        self.t = [[-v if b[i] < 0 else v for v in row] + [Fraction(i == j) for j in range(m)] for i, row in enumerate(a)]
        self.x, self.basis = [abs(v) for v in b], [self.n + i for i in range(m)]
        self.upper, self.high, self.frozen = [*upper, *[None] * m], [False] * (self.n + m), [False] * (self.n + m)
        self.optimise([Fraction(0)] * self.n + [Fraction(-1)] * m, freeze=False)
        self.feasible = all(v == 0 for v, k in zip(self.x, self.basis, strict=True) if k >= self.n)
        for k in range(self.n, self.n + m):  # the artificial variables stay at zero
            self.upper[k], self.frozen[k] = Fraction(0), True

    def optimise(self, cost: list[Fraction], freeze: bool = True) -> None:
        cost = [*cost, *[Fraction(0)] * (len(self.upper) - len(cost))]
        z = list(cost)
        for row, k in zip(self.t, self.basis, strict=True):
            if cost[k]:
                z = [zj - cost[k] * v for zj, v in zip(z, row, strict=True)]
        while True:
            basic = set(self.basis)
            j = next((j for j, d in enumerate(z) if d and (d < 0) == self.high[j] and not self.frozen[j] and j not in basic and self.upper[j] != 0), None)
            if j is None:
                break
            self._step(j, z)
        if freeze:
            basic = set(self.basis)
            self.frozen = [f or (d != 0 and k not in basic) for k, (f, d) in enumerate(zip(self.frozen, z, strict=True))]

    def _step(self, j: int, z: list[Fraction]) -> None:
        sign = -1 if self.high[j] else 1
        best = None if self.upper[j] is None else (self.upper[j], j, -1)
        for i, (row, k) in enumerate(zip(self.t, self.basis, strict=True)):
            v = sign * row[j]
            if v > 0:
                limit = self.x[i] / v
            elif v < 0 and self.upper[k] is not None:
                limit = (self.upper[k] - self.x[i]) / -v
            else:
                continue
            if best is None or (limit, k) < best[:2]:
                best = (limit, k, i)
        if best is None:
            raise ValueError("unbounded")
        far, _, i = best
        falls = i >= 0 and sign * self.t[i][j] > 0
        self.x = [x - sign * row[j] * far for x, row in zip(self.x, self.t, strict=True)]
        if i < 0:
            self.high[j] = not self.high[j]
            return
        out, self.basis[i] = self.basis[i], j
        self.high[out], self.x[i] = not falls, self.upper[j] - far if sign < 0 else far
        self.high[j] = False
        p = self.t[i][j]
        pivot = self.t[i] = [v / p for v in self.t[i]]
        for r in [*self.t[:i], *self.t[i + 1 :], z]:
            if f := r[j]:
                r[:] = [a - f * b if b else a for a, b in zip(r, pivot, strict=True)]

    def values(self) -> list[Fraction]:
        out = [self.upper[k] if self.high[k] else Fraction(0) for k in range(self.n)]
        for x, k in zip(self.x, self.basis, strict=True):
            if k < self.n:
                out[k] = x
        return out


Side = tuple[dict[str, Fraction], Fraction]  # coefficients, and the most that their sum may be


def feasible(sides: list[Side]) -> bool:
    """Whether some numbers, of any sign, keep all sides."""
    names = sorted({k for c, _ in sides for k in c})
    n, m = len(names), len(sides)
    a = [[*(c.get(k, Fraction(0)) for k in names), *(-c.get(k, Fraction(0)) for k in names), *(Fraction(i == j) for j in range(m))] for i, (c, _) in enumerate(sides)]
    return Simplex(a, [b for _, b in sides], [None] * (2 * n + m)).feasible


class Bounded:
    """Which constraints, of those given by id, have a common solution; each search goes on from where the last one ended.

    Sides on multiples of one sum of variables are bounds of one row. A variable of a row's own is pivoted against
    variables that have none or stay inside theirs, always the first by number, so that it ends. What is not basic lies on a
    whole number (bounds are taken times their common denominator) and rows are kept as whole numbers over one divisor: all is
    exact. Sets of ids are bits of an int."""

    def __init__(self, sides: list[list[Side]]):
        names = sorted({k for own in sides for c, _ in own for k in c})
        self.n = n = len(names)
        self.row_of: dict[tuple[int, ...], int] = {tuple(int(i == j) for j in range(n)): i for i in range(n)}
        bounds: list[tuple[int, bool, Fraction, int]] = []
        self.never = 0  # ids that no numbers keep: 0 <= b where b < 0
        for who, own in enumerate(sides):
            for c, most in own:
                terms = [c.get(k, 0) for k in names]
                if not any(terms):
                    self.never |= (1 << who) if most < 0 else 0
                    continue
                up = lcm(*(v.denominator for v in terms))
                whole = [v.numerator * (up // v.denominator) for v in terms]
                by = gcd(*whole) * (1 if next(filter(None, whole)) > 0 else -1)
                row = self.row_of.setdefault(tuple(v // by for v in whole), len(self.row_of))
                bounds.append((row, by > 0, most * up / by, who))
        unit = lcm(*(b.denominator for _, _, b, _ in bounds))
        rows = list(self.row_of)
        self.above: list[list[tuple[int, int]]] = [[] for _ in rows]  # (bound, id), the tightest first
        self.below: list[list[tuple[int, int]]] = [[] for _ in rows]
        for row, is_upper, b, who in bounds:
            (self.above if is_upper else self.below)[row].append((b.numerator * (unit // b.denominator), who))
        for up, low in zip(self.above, self.below, strict=True):
            up.sort()
            low.sort(reverse=True)
        self.free = list(range(n))  # what is not basic, with its value; a basic row is its terms over these, and their divisor
        self.at = dict.fromkeys(self.free, 0)
        self.rows = {r: ([*terms], 1) for terms, r in self.row_of.items() if r >= n}

    def _value(self, row: int) -> tuple[int, int]:
        terms, by = self.rows[row]
        return sum(t * self.at[k] for t, k in zip(terms, self.free, strict=True) if t), by

    def _pivot(self, row: int, place: int, value: int) -> None:
        """The row leaves the basis for the free one at this place, and lies on value."""
        terms, by = self.rows.pop(row)
        p, enters = terms[place], self.free[place]
        sign = 1 if p > 0 else -1
        solved = [-sign * t for t in terms]
        solved[place] = sign * by
        solved, p = _reduced(solved, abs(p))
        for r, (ts, d) in self.rows.items():
            if f := ts[place]:
                got = [f * v + (0 if i == place else t * p) for i, (t, v) in enumerate(zip(ts, solved, strict=True))]
                self.rows[r] = _reduced(got, d * p)
        self.rows[enters] = solved, p
        self.free[place] = row
        del self.at[enters]
        self.at[row] = value

    def clash(self, some: int) -> int:
        """0 if these have a common solution; else ids among them that have none."""
        if hit := self.never & some:
            return hit & -hit
        high = [next((x for x in b if some >> x[1] & 1), None) for b in self.above]
        low = [next((x for x in b if some >> x[1] & 1), None) for b in self.below]
        for h, w in zip(high, low, strict=True):
            if h and w and h[0] < w[0]:
                return 1 << h[1] | 1 << w[1]
        for k, v in self.at.items():
            if high[k] and v > high[k][0]:
                self.at[k] = high[k][0]
            elif low[k] and v < low[k][0]:
                self.at[k] = low[k][0]
        while True:
            for r in sorted(self.rows):
                value, by = self._value(r)
                if high[r] and value > high[r][0] * by:
                    bound, rises = high[r], False
                    break
                if low[r] and value < low[r][0] * by:
                    bound, rises = low[r], True
                    break
            else:
                return 0
            place, core = None, 1 << bound[1]
            for i, (t, k) in enumerate(zip(self.rows[r][0], self.free, strict=True)):
                if t:
                    stop = (high if (t > 0) == rises else low)[k]
                    if stop is None or self.at[k] != stop[0]:
                        place = i if place is None or k < self.free[place] else place
                    else:
                        core |= 1 << stop[1]
            if place is None:
                return core
            self._pivot(r, place, bound[0])

    def broken(self) -> int:
        """The ids that the last search's numbers break, as bits."""
        broken = self.never
        for r, (up, low) in enumerate(zip(self.above, self.below, strict=True)):
            value, by = (self.at[r], 1) if r in self.at else self._value(r)
            for b, who in up:
                if value <= b * by:
                    break
                broken |= 1 << who
            for b, who in low:
                if value >= b * by:
                    break
                broken |= 1 << who
        return broken


def _reduced(terms: list[int], by: int) -> tuple[list[int], int]:
    d = gcd(by, *terms)
    return (terms, by) if d == 1 else ([t // d for t in terms], by // d)


def first_hitting(sets: list[int], n: int) -> int:
    """The smallest, then first, choice of n ids that meets every set; sets and choice as bits."""

    def search(at: int, chosen: int, left: list[int], size: int) -> int | None:
        if not left:
            return chosen
        if not size or any(not s >> at for s in left):
            return None
        for i in range(at, n):
            rest = [s for s in left if not s >> i & 1]
            if len(rest) < len(left) and (got := search(i + 1, chosen | 1 << i, rest, size - 1)) is not None:
                return got
        return None

    return next(got for size in range(n + 1) if (got := search(0, 0, sets, size)) is not None)


def smallest_infeasible(sides: dict[str, list[Side]]) -> list[str] | None:
    """The smallest, then first, subset of the constraints (by id) without a solution; None if all together have one.

    What numbers that keep a subset break must be met by every infeasible one; so the smallest choice that meets all such
    rests found so far is either infeasible, and then the answer, or grows to another rest. A rest is made small by trying
    to keep more, but for what a clash found earlier forbids."""
    ids = sorted(sides)
    search, everyone = Bounded([sides[i] for i in ids]), (1 << len(ids)) - 1
    clashes = [search.clash(everyone)]
    if not clashes[0]:
        return None

    def clash(some: int) -> bool:
        if any(c & some == c for c in clashes):
            return True
        if hit := search.clash(some):
            clashes.append(hit)
        return bool(hit)

    rests: list[int] = []
    while True:
        some = first_hitting(rests, len(ids))
        if clash(some):
            return [x for i, x in enumerate(ids) if some >> i & 1]
        rest = search.broken()
        for i in range(len(ids)):
            if rest >> i & 1 and not clash((everyone ^ rest) | 1 << i):
                rest = search.broken()
        rests.append(rest)


def portfolio(scores: list[Fraction], caps: list[Fraction], current: list[Fraction], groups: list[tuple[list[int], Fraction, Fraction]], cash: tuple[Fraction, Fraction], cash_now: Fraction, holdings: int, turnover: Fraction | None, penalty: Fraction, most_nodes: int = 20_000) -> tuple[list[Fraction], Fraction] | None:
    """Weights and cash that maximise score . w - penalty * |w - current|, of equal values the lexicographically greatest by
    position, then cash; None if nothing satisfies all constraints.

    Of a weight, what lies above and below the current one are variables of their own. The number of holdings is met by
    branch and bound: an asset that is one too many is either left out or counts among those that may be held; the others'
    shares of their caps may then sum to no more than the number that is left. Over most_nodes branches are an Unproven."""
    n, zero, one = len(scores), Fraction(0), Fraction(1)

    def relaxed(out: frozenset[int], sure: frozenset[int]):
        base = [zero if i in out else min(current[i], caps[i]) for i in range(n)]
        kept = min(max(cash_now, cash[0]), cash[1])
        ranges = [(zero if i in out else caps[i] - base[i], base[i]) for i in range(n)] + [(cash[1] - kept, kept - cash[0])]
        forced = sum(c - b for c, b in zip(current, base, strict=True)) + abs(kept - cash_now)
        cols = [(i, s) for i, (up, down) in enumerate(ranges) for s, size in ((1, up), (-1, down)) if size > 0]
        upper = [ranges[i][0 if s > 0 else 1] for i, s in cols]
        a, b, slack = [[Fraction(s) for _, s in cols]], [one - sum(base) - kept], []
        for members, low, high in groups:
            inside = set(members)
            a.append([Fraction(s) if i in inside else zero for i, s in cols])
            b.append(high - sum(base[i] for i in inside))
            slack.append((len(a) - 1, high - low))
        if turnover is not None:
            # a forced sale of a weight above its cap may be made up for by no purchase of the same asset
            a.append([one] * len(cols))
            b.append(2 * turnover - forced)
            slack.append((len(a) - 1, None))
        if holdings < n:
            open_ = [i for i in range(n) if i not in sure and caps[i] > 0]
            a.append([Fraction(s) / caps[i] if i in open_ else zero for i, s in cols])
            b.append(holdings - len(sure) - sum(base[i] / caps[i] for i in open_))
            slack.append((len(a) - 1, None))
            sold = sorted(base[i] for i in range(n) if i not in sure and base[i] > 0)
            over = len(sold) + sum(base[i] > 0 for i in sure) - holdings
            if over > 0:  # so many of these must be sold whole
                a.append([-one if s < 0 and i < n and i not in sure else zero for i, s in cols])
                b.append(-sum(sold[:over]))
                slack.append((len(a) - 1, None))
        a = [[*row, *(Fraction(r == i) for r, _ in slack)] for i, row in enumerate(a)]
        if any(size is not None and size < 0 for _, size in slack):
            return None
        s = Simplex(a, b, [*upper, *(size for _, size in slack)])
        if not s.feasible:
            return None
        worth = [*scores, zero]
        s.optimise([worth[i] * d - (penalty if i < n else zero) for i, d in cols])
        for k in range(n + 1):  # on the best face, one position after the other
            if any(i == k for i, _ in cols):
                s.optimise([Fraction(d) if i == k else zero for i, d in cols])
        w = [*base, kept]
        for (i, d), v in zip(cols, s.values(), strict=False):
            w[i] += d * v
        value = sum(x * y for x, y in zip(scores, w, strict=False)) - penalty * sum(abs(x - c) for x, c in zip(w, current, strict=False))
        return value, w

    best, work, nodes = None, [(frozenset(), frozenset())], 0
    while work:
        nodes += 1
        if nodes > most_nodes:
            raise Unproven
        out, kept = work.pop()
        got = relaxed(out, kept)
        if got is None or (best is not None and got <= best):
            continue
        held = [i for i in range(n) if got[1][i] > 0]
        if len(held) <= holdings:
            best = got
            continue
        i = min((i for i in held if i not in kept), key=lambda i: (got[1][i], i))
        work.append((out | {i}, kept))
        if len(kept) + 1 <= holdings:
            more = kept | {i}
            work.append((frozenset(range(n)) - more if len(more) == holdings else out, more))
    return None if best is None else (best[1], best[0])
