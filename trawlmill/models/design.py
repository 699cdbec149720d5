"""Model terms as features of a row and a linear map from features to coefficients.

A feature is a product of atoms (an indicator of a factor level, a number, a radial
function of coordinates).  The same atoms are evaluated by NumPy inside fitting
tasks and by Spark expressions for predictions.  Constraints of smooth terms live in
the map: design matrix = features x map.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Atom = tuple
# Basis dimension of a two-dimensional smooth and of a tensor margin.
SMOOTH_KNOTS = 30
TENSOR_KNOTS = 5


@dataclass(frozen=True)
class Smooth:
    """Smooth of one or two coordinates.

    ``kind`` is "plate" (thin plate) or "tensor" (product of cubic splines); ``by``
    gives one smooth per level of a factor.
    """

    variables: tuple[str, ...]
    kind: str = "plate"
    by: str | None = None
    k: int = SMOOTH_KNOTS


@dataclass(frozen=True)
class Formula:
    """Response, parametric terms (tuples of variable names), smooths, log-offset."""

    response: str
    terms: tuple[tuple[str, ...], ...]
    smooths: tuple[Smooth, ...] = ()
    offset: str | None = None

    def variables(self) -> list[str]:
        names = [v for t in self.terms for v in t]
        for s in self.smooths:
            names += [*s.variables, *([s.by] if s.by else [])]
        return list(dict.fromkeys(names))

    def plus(self, *terms: tuple[str, ...]) -> "Formula":
        return Formula(self.response, (*self.terms, *terms), self.smooths, self.offset)


def crossed(*names: str) -> tuple[tuple[str, ...], ...]:
    """All main effects and interactions of the names (a*b)."""
    out: list[tuple[str, ...]] = [()]
    for n in names:
        out += [(*t, n) for t in out]
    return tuple(sorted((t for t in out if t), key=len))


@dataclass
class Space:
    """Levels of the factors and knots of the coordinates, shared by all fits."""

    levels: Mapping[str, list]
    knots: Mapping[tuple[str, ...], np.ndarray] = field(default_factory=dict)


@dataclass
class Block:
    """Smooth part of a design: its coefficients, penalties and how they are chosen."""

    label: str
    start: int
    stop: int
    penalties: list[np.ndarray]


@dataclass
class Design:
    features: list[tuple[Atom, ...]]
    map: np.ndarray
    names: list[str]
    term_of: list[str]
    blocks: list[Block]
    #: of a smooth by a factor: the factor, the features of one level without its indicator, where each level's begin
    by: tuple[str, list[tuple[Atom, ...]], list[int]] | None = None

    @property
    def border(self) -> list[int]:
        """Features that rows of several levels share."""
        if self.by is None:
            return list(range(len(self.features)))
        _, base, starts = self.by
        own = {j for s in starts for j in range(s, s + len(base))}
        return [j for j in range(len(self.features)) if j not in own]

    @property
    def size(self) -> int:
        return self.map.shape[1]


def _null_space(t: np.ndarray) -> np.ndarray:
    q, _ = np.linalg.qr(t, mode="complete")
    return q[:, t.shape[1] :]


def _plate(variables: Sequence[str], knots: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Radial features plus linear ones; constant removed; curvature penalty."""
    d = knots.shape[1]
    centre, scale = knots.mean(axis=0), float(np.ptp(knots, axis=0).max()) or 1.0
    u = (knots - centre) / scale
    r = np.sqrt(((u[:, None, :] - u[None, :, :]) ** 2).sum(-1))
    with np.errstate(divide="ignore", invalid="ignore"):
        e = np.where(r > 0, r * r * np.log(r), 0.0) if d == 2 else r**3
    z = _null_space(np.column_stack([np.ones(len(u)), u]))
    shape = tuple(centre.tolist()), scale
    radial = [(("radial", tuple(variables), tuple(k), *shape),) for k in u.tolist()]
    linear = [(("scaled", v, centre[i].item(), scale),) for i, v in enumerate(variables)]
    # 1-D: r^3 and 2-D: r^2 log r are both positive semi-definite on the null space
    pen = z.T @ e @ z
    pen = (pen + pen.T) / 2
    norm = float(np.abs(pen).max()) or 1.0
    full = np.zeros((len(radial) + len(linear),) * 2)[:, : z.shape[1] + len(linear)]
    full[: len(radial), : z.shape[1]] = z
    full[len(radial) :, z.shape[1] :] = np.eye(len(linear))
    penalty = np.zeros((full.shape[1],) * 2)
    penalty[: z.shape[1], : z.shape[1]] = pen / norm
    return radial + linear, full, penalty


def _tensor(variables: Sequence[str], knots: Sequence[np.ndarray]):
    """Products of one-dimensional cubic bases, one penalty per margin."""
    margins = []
    for v, k in zip(variables, knots):
        feats, mapping, pen = _plate([v], k.reshape(-1, 1))
        n, m = mapping.shape
        whole = np.zeros((n + 1, m + 1))
        whole[0, 0] = 1.0
        whole[1:, 1:] = mapping
        penalty = np.zeros((m + 1, m + 1))
        penalty[1:, 1:] = pen
        margins.append(([()] + feats, whole, penalty))
    feats, mapping = margins[0][0], margins[0][1]
    penalties = [margins[0][2]]
    for f2, m2, p2 in margins[1:]:
        feats = [a + b for a in feats for b in f2]
        penalties = [np.kron(p, np.eye(m2.shape[1])) for p in penalties]
        penalties.append(np.kron(np.eye(mapping.shape[1]), p2))
        mapping = np.kron(mapping, m2)
    # the product of the two constants is the model intercept
    return feats[1:], mapping[1:, 1:], [p[1:, 1:] for p in penalties]


def build_design(formula: Formula, space: Space) -> Design:
    """Intercept, treatment-coded terms in order, then the smooths."""
    features: list[tuple[Atom, ...]] = [()]
    names, term_of = ["(Intercept)"], ["(Intercept)"]
    for term in formula.terms:
        label = ":".join(term)
        combos: list[tuple[tuple[Atom, ...], str]] = [((), "")]
        for var in term:
            if var in space.levels:
                atoms = [(("level", var, i), f"{var}{lv}") for i, lv in enumerate(space.levels[var])][1:]
            else:
                atoms = [(("number", var), var)]
            combos = [(f + (a,), f"{n}:{x}" if n else x) for f, n in combos for a, x in atoms]
        features += [f for f, _ in combos]
        names += [n for _, n in combos]
        term_of += [label] * len(combos)
    parametric = len(features)
    maps = [np.eye(parametric)]
    blocks: list[Block] = []
    by = None
    at = parametric
    for s in formula.smooths:
        if s.kind == "plate":
            f, m, p = _plate(s.variables, space.knots[s.variables])
            penalties = [p]
        else:
            f, m, penalties = _tensor(s.variables, [space.knots[(v,)] for v in s.variables])
        if s.by is None:
            pieces = [(f, m, penalties, "")]
        else:
            pieces = [
                ([(("level", s.by, i), *x) for x in f], m, penalties, f":{s.by}{lv}")
                for i, lv in enumerate(space.levels[s.by])
            ]
            if by is None:
                by = (s.by, f, [len(features) + i * len(f) for i in range(len(pieces))])
        head = {"plate": "s", "tensor": "te"}[s.kind]
        for f, m, penalties, suffix in pieces:
            label = f"{head}({','.join(s.variables)}){suffix}"
            features += f
            maps.append(m)
            names += [f"{label}.{i + 1}" for i in range(m.shape[1])]
            term_of += [label] * m.shape[1]
            blocks.append(Block(label, at, at + m.shape[1], penalties))
            at += m.shape[1]
    whole = np.zeros((len(features), at))
    r = c = 0
    for m in maps:
        whole[r : r + m.shape[0], c : c + m.shape[1]] = m
        r, c = r + m.shape[0], c + m.shape[1]
    return Design(features, whole, names, term_of, blocks, by)


# --- evaluation --------------------------------------------------------------------------


def code_name(var: str) -> str:
    return f"{var}__code"


def level_code(var: str, levels: Sequence) -> Column:
    """Position of the row's level in the list; NULL for a level that is not in it."""
    if not levels:
        return F.lit(None).cast("int")
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(var))
    return (F.nullif(place, F.lit(0)) - 1).cast("int")


def atom_values(atom: Atom, columns: Mapping[str, np.ndarray]) -> np.ndarray:
    kind = atom[0]
    if kind == "level":
        return (columns[code_name(atom[1])] == atom[2]).astype(float)
    if kind == "number":
        return columns[atom[1]]
    if kind == "scaled":
        return (columns[atom[1]] - atom[2]) / atom[3]
    _, variables, knot, centre, scale = atom
    r2 = sum(
        ((columns[v] - c) / scale - k) ** 2 for v, c, k in zip(variables, centre, knot)
    )
    if len(variables) == 1:
        return r2**1.5
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(r2 > 0, 0.5 * r2 * np.log(r2), 0.0)


def feature_matrix(
    features: Sequence[tuple[Atom, ...]],
    columns: Mapping[str, np.ndarray],
    n: int,
    cache: dict[Atom, np.ndarray],
) -> np.ndarray:
    out = np.ones((n, len(features)))
    for j, atoms in enumerate(features):
        for atom in atoms:
            if atom not in cache:
                cache[atom] = atom_values(atom, columns)
            out[:, j] *= cache[atom]
    return out


def atom_column(atom: Atom, space: Space) -> Column:
    kind = atom[0]
    if kind == "level":
        level = space.levels[atom[1]][atom[2]]
        return (F.col(atom[1]) == F.lit(level)).cast("double")
    if kind == "number":
        return F.col(atom[1]).cast("double")
    if kind == "scaled":
        return (F.col(atom[1]) - atom[2]) / atom[3]
    _, variables, knot, centre, scale = atom
    r2 = F.lit(0.0)
    for v, c, k in zip(variables, centre, knot):
        r2 = r2 + F.pow((F.col(v) - c) / scale - k, 2)
    if len(variables) == 1:
        return F.pow(r2, 1.5)
    return F.when(r2 > 0, 0.5 * r2 * F.ln(F.when(r2 > 0, r2))).otherwise(0.0)


def feature_array(features: Sequence[tuple[Atom, ...]], space: Space) -> Column:
    """All features of a row as one array column."""
    cols = []
    for atoms in features:
        col = F.lit(1.0)
        for atom in atoms:
            col = col * atom_column(atom, space)
        cols.append(col)
    return F.array(*cols)


# --- levels and knots ------------------------------------------------------------------------

def factor_levels(df: DataFrame, factors: Sequence[str]) -> dict[str, list]:
    """Sorted levels of each factor of a dense design.

    These cost a coefficient each, so the design names only factors whose levels do not
    grow with the data (year, month, party); vessels take the absorbed role (``absorbed.py``).
    """
    return {
        name: sorted(r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().collect())
        for name in factors
    }


def spatial_knots(df: DataFrame, lon: str, lat: str, k: int = SMOOTH_KNOTS) -> np.ndarray:
    """``k`` occupied grid cells spread by farthest-point choice.

    The candidates are half-degree cells.  Positions beyond 180 and 90 degrees are no candidates, so there are at most
    720 x 360 of them.
    """
    cell = lambda c: (F.floor(F.col(c) * 2) / 2 + 0.25).alias(c)
    known = df.where(F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90))
    rows = known.select(cell(lon), cell(lat)).distinct().dropna().collect()
    if not rows:
        raise ValueError(f"{lon} and {lat} hold no position in degrees")
    pts = np.array(sorted((r[0], r[1]) for r in rows), dtype=float)
    chosen = [int(((pts - pts.mean(axis=0)) ** 2).sum(1).argmin())]
    gap = ((pts - pts[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(pts)):
        nxt = int(gap.argmax())
        chosen.append(nxt)
        gap = np.minimum(gap, ((pts - pts[nxt]) ** 2).sum(1))
    return pts[sorted(chosen)]


def margin_knots(df: DataFrame, variables: Sequence[str], k: int = TENSOR_KNOTS) -> dict[tuple[str, ...], np.ndarray]:
    """Evenly spread sample quantiles of each coordinate (sketch of bounded size)."""
    probs = [i / (k - 1) for i in range(k)]
    row = df.agg(
        *[F.percentile_approx(v, F.array(*[F.lit(p) for p in probs]), F.lit(10000)).alias(v) for v in variables]
    ).first()
    return {(v,): np.unique(np.array(row[v], dtype=float)) for v in variables}
