"""The one-to-one choice among people whose names can meet, without a table of their pairs.

Pairs are taken by descending score, then by xrefs. They are made in bands of scores from the top down, and only of people
whom no band before has taken, so of pairs that cannot be chosen any more few are made. Scores and vetoes are those of
``linkage.compared`` and ``linkage.total_score``, in the same order of operations; tests hold them against these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

A, B, NEAR, NAMES = range(4)  # kinds of rows
EXACT, ABT, BEF, AFT, BET = range(5)  # qualifiers
#: So many pairs are made at a time.
CHUNK = 1_000_000
EVENTS = ("birth", "death")
NUMBERS = ("sex", "born", "first", "last", "roles", *(f"{e}_{c}" for e in EVENTS for c in ("q", "year", "month", "day", "year2", "none")))
#: A row of a group: people have an xref (x), a class (y) and all that follows; pairs of relatives xrefs (x, y) and a score (s); pairs
#: of names their classes (x, y) and how alike surnames (s) and given names (g) are.
SCHEMA = "comp string, kind int, x string, y string, s double, g double, birth_at string, death_at string, " + ", ".join(f"{c} int" for c in NUMBERS)
CHOSEN = "xref_a string, xref_b string, score double"
ORIGIN, SPAN = 20_000, 100_000  # years, shifted, are less than SPAN
Side = dict[str, np.ndarray]


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row as many as it counts: its number, and 0, 1, ... within it."""
    at = np.repeat(np.arange(len(counts)), counts)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)


def chunks(counts: np.ndarray) -> Iterator[slice]:
    """Slices of rows that count CHUNK together, or a row."""
    part = (np.cumsum(counts) - counts) // CHUNK
    ends = [*(np.flatnonzero(np.diff(part)) + 1), len(counts)] if len(counts) else []
    start = 0
    for end in ends:
        yield slice(start, end)
        start = end


def take(side: Side, at: np.ndarray) -> Side:
    return {k: v[at] for k, v in side.items()}


class Places:
    """``text.compared_places`` of numbered places, each pair worked out once."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b = ([(p, [w for w in (w.strip(" ") for w in p.split(",")) if w]) for p in x] for x in (a, b))
        self.known: dict[int, float] = {}

    def one(self, i: int, j: int) -> float:
        (x, px), (y, py) = self.a[i], self.b[j]
        if x == y:
            return 1.0
        if not x or not y:
            return 0.0
        either = len({*px, *py})
        shared = len({*px} & {*py}) / either if either else 1.0
        return min(shared + (0.2 if px and py and px[0] == py[0] else 0.0), 1.0)

    def similarity(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        found, at = np.unique(i * len(self.b) + j, return_inverse=True)
        for code in found.tolist():
            if code not in self.known:
                self.known[code] = self.one(*divmod(code, len(self.b)))
        return np.array([self.known[c] for c in found.tolist()], float)[at]


def overlap(a: Side, b: Side, e: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``dates.date_overlap`` of rows i of a and j of b."""
    x, y = (lambda c: a[f"{e}_{c}"][i]), (lambda c: b[f"{e}_{c}"][j])
    ea, eb, year_a, year_b = x("exact"), y("exact"), x("year"), y("year")
    above, below = y("low") - x("high"), x("low") - y("high")
    gap = np.maximum(above, below)
    both, either = ea & eb, ea | eb
    out = np.where(gap > 0, np.where(~both & (gap <= 8), 0.4, 0.0), np.where(either, 0.7, 0.6))
    at = np.flatnonzero(both & (np.abs(year_a - year_b) <= 2))
    year = year_a[at] == year_b[at]
    month, day = (a[f"{e}_{c}"][i[at]] == b[f"{e}_{c}"][j[at]] for c in ("month", "day"))
    out[at] = np.where(year & month & day, 1.0, np.where(year & month, 0.9, np.where(year, 0.8, 0.5)))
    out[np.isnan(year_a) | np.isnan(year_b)] = 0.3
    return out


def event(a: Side, b: Side, e: str, i: np.ndarray, j: np.ndarray, places: Places) -> np.ndarray:
    """``linkage.event_score``."""
    lost = a[f"{e}_lost"][i] | b[f"{e}_lost"][j]
    out = np.full(len(i), 0.5)
    at = np.flatnonzero(~lost)
    i, j = i[at], j[at]
    out[at] = 0.7 * overlap(a, b, e, i, j) + 0.3 * placed(a, b, e, i, j, places)
    return out


def placed(a: Side, b: Side, e: str, i: np.ndarray, j: np.ndarray, places: Places | None) -> np.ndarray:
    """How alike the places are; without ``places`` as if those that are there agreed."""
    either = a[f"{e}_none"][i] | b[f"{e}_none"][j]
    out = np.where(either, 0.5, 1.0)
    if places is not None:
        at = np.flatnonzero(~either)
        out[at] = places.similarity(a[f"{e}_place"][i[at]], b[f"{e}_place"][j[at]])
    return out


def vetoed(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What ``linkage.compared`` leaves out before it looks at sex. Comparisons with what is not known are false."""
    x, y = (lambda c: a[c][i]), (lambda c: b[c][j])
    birth_a, birth_b, death_a, death_b = x("birth_year"), y("birth_year"), x("death_year"), y("death_year")
    out = (np.abs(x("born") - y("born")) > 50) | (np.abs(death_a - death_b) > 25) | (death_a < birth_b) | (death_b < birth_a)
    out |= x("dated") & y("dated") & (np.abs(birth_a - birth_b) > 5)
    return out | (x("last") < y("first")) | (y("last") < x("first"))


class Group:
    """A group of names that can meet: its people, pairs of names and pairs of relatives."""

    def __init__(self, rows: pd.DataFrame, weights: dict[str, float], least: float) -> None:
        self.weights, self.least = weights, least
        self.ids: list[np.ndarray] = []
        names = rows[rows["kind"] == NAMES]
        sides: list[Side] = []
        for kind, c in ((A, "x"), (B, "y")):
            people = rows[rows["kind"] == kind]
            ids, node = np.unique(people["x"].to_numpy(object), return_inverse=True)
            self.ids.append(ids)
            classes = pd.Index(names[c].unique())
            side = {n: people[n].to_numpy(float, na_value=np.nan) for n in NUMBERS}
            side |= {"node": node, "class": classes.get_indexer(people["y"]), "roles": np.nan_to_num(side["roles"]).astype(int)}
            side |= {"name": classes.get_indexer(names[c])}
            for e in EVENTS:
                q, year, year2, none = (side.pop(f"{e}_q"), side[f"{e}_year"], side.pop(f"{e}_year2"), side[f"{e}_none"] == 1)
                high = np.where(q == BET, np.where(np.isnan(year2), year, year2), np.where(q == AFT, 9999, np.where(q == ABT, year + 2, year)))
                side |= {f"{e}_low": np.where(q == BEF, 0, np.where(q == ABT, year - 2, year)), f"{e}_high": high, f"{e}_exact": q == EXACT}
                side |= {f"{e}_none": none, f"{e}_lost": np.isnan(year) & none, f"{e}_narrow": q <= ABT}
            side["dated"] = ~np.isnan(side["birth_month"]) & side["birth_exact"]
            sides.append(side)
        self.name = {"a": sides[0].pop("name"), "b": sides[1].pop("name"), "surname": names["s"].to_numpy(float), "given": names["g"].to_numpy(float)}
        self.places = {}
        for e in EVENTS:
            both = []
            for side, kind in zip(sides, (A, B)):
                found, side[f"{e}_place"] = np.unique(rows.loc[rows["kind"] == kind, f"{e}_at"].fillna("").to_numpy(object), return_inverse=True)
                both.append(found)
            self.places[e] = Places(*both)
        self.sides = [take(s, np.flatnonzero(s["class"] >= 0)) for s in sides]
        near = rows[rows["kind"] == NEAR]
        index = [pd.Index(ids) for ids in self.ids]
        self.near = [index[0].get_indexer(near["x"]), index[1].get_indexer(near["y"]), near["s"].to_numpy(float)]

    def meet(self, a: Side, b: Side, year: str, width: int, names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of names, of rows of a, of b) of pairs of those names whose years differ by the width at most."""
        key = lambda side: side["class"].astype(np.int64) * SPAN + side[year].astype(np.int64) + ORIGIN
        order_a, order_b = np.argsort(key(a), kind="stable"), np.argsort(key(b), kind="stable")
        class_a, key_b = a["class"][order_a], key(b)[order_b]
        first = np.searchsorted(class_a, self.name["a"][names])
        of_name = np.searchsorted(class_a, self.name["a"][names], "right") - first
        for some in chunks(of_name):
            n, at = spread(of_name[some])
            n += some.start
            row = order_a[first[n] + at]
            middle = self.name["b"][names[n]].astype(np.int64) * SPAN + a[year][row].astype(np.int64) + ORIGIN
            low = np.searchsorted(key_b, middle - width)
            counts = np.searchsorted(key_b, middle + width, "right") - low
            for part in chunks(counts):
                k, at = spread(counts[part])
                if len(k):
                    yield names[n[part][k]], row[part][k], order_b[low[part][k] + at]

    def scored(self, a: Side, b: Side, i: np.ndarray, j: np.ndarray, n: np.ndarray, birth: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
        """Of pairs of people (rows i of a, j of b) with their names and the births' score: nodes and score of those from least on."""
        w = self.weights
        keep = np.flatnonzero((a["roles"][i] & b["roles"][j] == 0) & ~vetoed(a, b, i, j))
        i, j, n, birth = i[keep], j[keep], n[keep], birth[keep]
        surname, given, death = self.name["surname"][n], self.name["given"][n], event(a, b, "death", i, j, self.places["death"])
        sex_a, sex_b = a["sex"][i], b["sex"][j]
        sex = np.where((sex_a == 0) | (sex_b == 0), 0.5, np.where(sex_a == sex_b, 1.0, 0.0))
        out = (sex == 0.0) & (surname + given + birth + death < 3.4)
        total = 0.0 + surname * w["surname"] + given * w["given"] + birth * w["birth"] + death * w["death"] + sex * w["sex"] + 0.5 * w["family"]
        keep = np.flatnonzero(~out & (total >= least - 1e-4))
        values, at = np.unique(total[keep], return_inverse=True)
        score = np.array([round(v, 4) for v in values.tolist()], float)[at]
        good = score >= least
        return a["node"][i[keep]][good], b["node"][j[keep]][good], score[good]

    def pairs(self, a: Side, b: Side, least: float) -> Iterator[tuple[np.ndarray, ...]]:
        """Nodes and scores of pairs of these people from ``least`` on, without family context.

        What is missing to 1 in the five other scores is then 0.125 at most, half of a death's weight of it where one has none.
        Births of two known years have to agree somewhat (0.375): narrow dates within 12 years, or within 4 where all but 0.7 x 0.4
        + 0.3 is too much to miss, others (0.7 x 0.7 + 0.3 at most) within the veto's 50; these are compared by birth (date and
        place) of a name, before the people that have it. Where a year is unknown births weigh 0.098 at least, so deaths have to
        agree by 0.72: in known years, within the veto's 25."""
        w = self.weights
        lack = (1 - self.name["surname"]) * w["surname"] + (1 - self.name["given"]) * w["given"]
        far, wide = ((1 - (0.7 * x + 0.3)) * w["birth"] for x in (0.4, 0.7))
        known = [take(s, np.flatnonzero(~np.isnan(s["birth_year"]))) for s in (a, b)]
        for lost_a in (False, True):
            for lost_b in (False, True):
                spare = 1 - 0.5 * w["family"] - least + 1e-4 - (0.5 * w["death"] if lost_a or lost_b else 0.0)
                born = [take(s, np.flatnonzero(s["death_lost"] == x)) for s, x in zip(known, (lost_a, lost_b))]
                for narrow_a in (True, False):
                    for narrow_b in (True, False):
                        both = narrow_a and narrow_b
                        names = np.flatnonzero(lack <= spare - (0.0 if both else wide))
                        sides = [take(s, np.flatnonzero(s["birth_narrow"] == x)) for s, x in zip(born, (narrow_a, narrow_b))]
                        if len(names) and all(len(s["node"]) for s in sides):
                            yield from self.by_birth(*sides, names, lack, spare, (12 if far <= spare else 4) if both else 50, least)
        spare = 1 - 0.5 * w["family"] - least + 1e-4 - 0.49 * w["birth"]
        dead = [take(s, np.flatnonzero(~np.isnan(s["death_year"]))) for s in (a, b)]
        names = np.flatnonzero(lack <= spare)
        if len(names) and all(len(s["node"]) for s in dead):
            for n, i, j in self.meet(*dead, "death_year", 25, names):
                keep = np.flatnonzero(np.isnan(dead[0]["birth_year"][i]) | np.isnan(dead[1]["birth_year"][j]))
                n, i, j = n[keep], i[keep], j[keep]
                keep = np.flatnonzero(lack[n] + (1 - (0.7 * overlap(*dead, "death", i, j) + 0.3)) * w["death"] <= spare)
                n, i, j = n[keep], i[keep], j[keep]
                yield self.scored(*dead, i, j, n, event(*dead, "birth", i, j, self.places["birth"]), least)

    def by_birth(self, a: Side, b: Side, names: np.ndarray, lack: np.ndarray, spare: float, width: int, least: float) -> Iterator[tuple[np.ndarray, ...]]:
        """Pairs of people of known births that differ by the width at most, and miss no more than spare with their names."""
        weight = self.weights["birth"]
        rows, cells, starts, sizes = [], [], [], []
        for side in (a, b):
            columns = ("class", "birth_place", *(f"birth_{c}" for c in ("none", "exact", "low", "high", "year", "month", "day")))
            rows.append(take(side, np.lexsort([side[c] for c in columns])))
            keys = [np.nan_to_num(rows[-1][c].astype(float), nan=-1) for c in columns]
            start = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in keys], axis=0)))
            cells.append({c: rows[-1][c][start] for c in columns})
            starts.append(start)
            sizes.append(np.diff(np.append(start, len(keys[0]))))
        for n, i, j in self.meet(*cells, "birth_year", width, names):
            missed, dates = lack[n], 0.7 * overlap(*cells, "birth", i, j)
            keep = np.flatnonzero(missed + (1 - (dates + 0.3)) * weight <= spare)
            n, i, j, missed, dates = n[keep], i[keep], j[keep], missed[keep], dates[keep]
            birth = dates + 0.3 * placed(*cells, "birth", i, j, self.places["birth"])
            keep = np.flatnonzero(missed + (1 - birth) * weight <= spare)
            n, i, j, birth = n[keep], i[keep], j[keep], birth[keep]
            counts = sizes[0][i] * sizes[1][j]
            for part in chunks(counts):
                k, at = spread(counts[part])
                of_b = sizes[1][j[part]][k]
                yield self.scored(*rows, starts[0][i[part]][k] + at // of_b, starts[1][j[part]][k] + at % of_b, n[part][k], birth[part][k], least)

    def choose(self, bands: tuple[float, ...]) -> pd.DataFrame:
        taken = [bytearray(len(ids)) for ids in self.ids]
        chosen: list[tuple[int, int, float]] = []
        for least in (*bands, self.least):
            gone = [np.frombuffer(bytes(t), np.uint8).astype(bool) for t in taken]
            left = [take(s, np.flatnonzero(~g[s["node"]])) for s, g in zip(self.sides, gone)]
            i, j, s = self.near
            open_ = (s >= least) & ~gone[0][i] & ~gone[1][j]
            found = [(i[open_], j[open_], s[open_]), *self.pairs(*left, least)]
            i, j, s = (np.concatenate([f[k] for f in found]) for k in range(3))
            order = np.lexsort((j, i, -s))
            for x, y, score in zip(i[order].tolist(), j[order].tolist(), s[order].tolist()):
                if not taken[0][x] and not taken[1][y]:
                    taken[0][x] = taken[1][y] = 1
                    chosen.append((x, y, score))
        x, y, score = zip(*chosen) if chosen else ((), (), ())
        ids = lambda side, at: self.ids[side][np.array(at, int)]
        return pd.DataFrame({"xref_a": pd.Series(ids(0, x), dtype=object), "xref_b": pd.Series(ids(1, y), dtype=object), "score": np.array(score, float)})
