"""Many Cox models over rows that are sorted once.

Rows are dealt by (stratum, time), sorted, and packed into blocks of NumPy arrays (``_packed``), written once.  Models
of a stratum share its rows; each has its own event label, coefficients, penalty and way of ties: the exits of
a state, or the trials of a search.  With the running sums over the risk set S0, S1, S2 (of w, w x, w x x') and the
sums D0, D1, D2 over the events of a time, the terms of ``operators.cox`` give

    gradient    = sum_events x - sum_u [a S1 - c D1]
    information = sum_u [a S2 - c D2] - sum_u [q0 S1 S1' - q1 (S1 D1' + D1 S1') + q2 D1 D1'],

sums over times u alone, so nothing is joined back to the rows.  An evaluation reads the blocks twice and
shuffles nothing: the first pass gives each block's totals, which add up to what follows every block; the second
runs over the times inside a block.  The first and the last time of a block can go on in its
neighbours; the first pass gives their sums by themselves, and they are put together on the driver.

A missing time comes before all others: it is in no risk set but its own, its terms count, its rows are in no
sum over rows.  A row with a missing covariate counts as a row and as an event, and is in no other sum.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.session import cut_lineage

#: Rows of a block, and of a partition of the sorted rows.
BLOCK_ROWS = 100_000
PARTITION_ROWS = 500_000
#: Terms of tied events that are held at once.
TIE_TERMS = 1_000_000


def _packed(rows: DataFrame, p: int, n: int) -> DataFrame:
    """(part, no, s, t, lab, x): the blocks of ``rows`` (s int, t double, lab int, x0.. double), in order."""
    import pyarrow as pa
    xs = [f"x{j}" for j in range(p)]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / PARTITION_ROWS))
    # rows of one time are cut by a hash: a time that holds many rows is not one task
    dealt = rows.select("s", "t", "lab", *xs).repartitionByRange(parts, "s", "t", F.xxhash64("lab", *xs)).sortWithinPartitions("s", "t")

    def pack(batches):
        from pyspark import TaskContext
        part, held, size, no = TaskContext.get().partitionId(), [], 0, 0

        def blocks():
            nonlocal no
            s, t, lab, *x = (np.concatenate(c) for c in zip(*held, strict=True))
            ends = [*(np.flatnonzero(s[1:] != s[:-1]) + 1), len(s)]
            for a, z in zip([0, *ends[:-1]], ends, strict=True):
                body = np.stack([c[a:z] for c in x]) if x else np.empty((0, z - a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([int(s[a])], pa.int32()),
                     *(pa.array([v.tobytes()], pa.binary()) for v in (t[a:z], lab[a:z], body))], names=["part", "no", "s", "t", "lab", "x"])
                no += 1

        for b in batches:
            if not b.num_rows:
                continue
            t = b.column("t")
            time = np.where(np.asarray(t.is_null()), -np.inf, t.to_numpy(zero_copy_only=False))
            held.append([b.column("s").to_numpy(), time, b.column("lab").to_numpy().astype(np.int16),
                         *(b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in xs)])
            size += b.num_rows
            if size >= BLOCK_ROWS:
                yield from blocks()
                held, size = [], 0
        if held:
            yield from blocks()

    return cut_lineage(dealt.mapInArrow(pack, "part int, no int, s int, t binary, lab binary, x binary"))


def efron_terms(S0: np.ndarray, D0: np.ndarray, d: np.ndarray, efron: bool) -> np.ndarray:
    """a, c, L, q0, q1, q2 (6 x times) of times with ``d`` events each, as ``cox._efron_terms``."""
    out = np.zeros((6, len(d)))
    one = d == 1 if efron else np.ones(len(d), bool)
    r = 1.0 / S0[one]
    out[0, one], out[2, one], out[3, one] = d[one] * r, d[one] * np.log(S0[one]), d[one] * r * r
    tied = np.flatnonzero(~one)
    while len(tied):
        upto = max(1, int(np.searchsorted(np.cumsum(d[tied]), TIE_TERMS, side="right")))
        now, tied = tied[:upto], tied[upto:]
        size = d[now].astype(np.int64)
        for low in range(0, int(size.max()) if len(now) == 1 else 1, TIE_TERMS):  # a very large tie alone, in parts
            part = np.minimum(size - low, TIE_TERMS) if len(now) == 1 else size
            begin = np.cumsum(part) - part
            f = (np.arange(part.sum()) - np.repeat(begin, part) + low) / np.repeat(size, part)
            z = np.repeat(S0[now], part) - f * np.repeat(D0[now], part)
            r = 1.0 / z
            fr = f * r
            out[:, now] += np.stack([np.add.reduceat(v, begin) for v in (r, fr, np.log(z), r * r, fr * r, fr * fr)])
    return out


@dataclass
class Sorted:
    """Packed rows and their models: ``of[m]`` = (stratum, label, efron)."""
    blocks: DataFrame
    p: int
    of: list

    def _read(self, fn: Callable, shared) -> list:
        """(part, no, fn's vector) of every block for which ``fn(block, models, shared)`` gives one."""
        import pyarrow as pa
        p, mine = self.p, defaultdict(list)
        for m, (s, label, efron) in enumerate(self.of):
            mine[s].append((m, label, efron))
        held = self.blocks.sparkSession.sparkContext.broadcast((dict(mine), shared))

        def run(batches):
            models, common = held.value
            for b in batches:
                for part, no, s, t, lab, x in zip(*(b.column(c) for c in ("part", "no", "s", "t", "lab", "x")), strict=True):
                    t = np.frombuffer(t.as_buffer(), float)
                    block = (part.as_py(), no.as_py(), s.as_py(), t, np.frombuffer(lab.as_buffer(), np.int16),
                             np.frombuffer(x.as_buffer(), float).reshape(p, len(t)))
                    v = fn(block, models.get(block[2], []), common)
                    if v is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([block[0]], pa.int32()), pa.array([block[1]], pa.int32()),
                                                          pa.array([np.asarray(v, float).tobytes()], pa.binary())], names=["part", "no", "v"])

        got = self.blocks.mapInArrow(run, "part int, no int, v binary").collect()
        held.destroy()
        return sorted(((r["part"], r["no"], np.frombuffer(r["v"], float)) for r in got), key=lambda r: r[:2])

    def _totals(self, betas: dict) -> _Totals:
        """The first pass, for the models that have coefficients in ``betas``."""
        return _Totals(self, betas, self._read(_block_totals, betas))

    def stats(self, betas: dict) -> dict:
        """{model: (log likelihood, gradient, information, rows, events)} at ``betas``."""
        p, q = self.p, 1 + self.p + self.p * self.p
        tot = self._totals(betas)
        sums = {m: np.zeros(q) for m in betas}
        for m in betas:
            sums[m] += tot.edge_terms(m)
        for part, no, v in self._read(_block_steps, (betas, tot.after)):
            for m, terms in zip(tot.models_of[part, no], v.reshape(-1, q), strict=True):
                sums[m] += terms
        out = {}
        for m in betas:
            n, ev, ll, ex = tot.rows[m]
            if n:
                info = sums[m][1 + p:].reshape(p, p)
                out[m] = (ll - sums[m][0], ex - sums[m][1:1 + p], (info + info.T) / 2, int(n), float(ev))
        return out

    # ---- baseline hazards at the fitted coefficients -----------------------
    def hazard_at(self, betas: dict, times: Sequence[float]) -> dict:
        """{model: [cumulative baseline hazard at each of ``times``]} (0 before the first event)."""
        times = [float(t) for t in times]
        tot = self._totals(betas)
        out = {m: np.array([sum(dh for t, dh in tot.edge_steps(m) if t <= u) for u in times], float) for m in betas}
        for part, no, v in self._read(_block_hazards, (betas, tot.after, times)):
            for m, h in zip(tot.models_of[part, no], v.reshape(-1, len(times)), strict=True):
                out[m] += h
        return {m: h.tolist() for m, h in out.items()}

    def curves(self, betas: dict) -> dict:
        """{model: (event times, cumulative baseline hazards)}: as many numbers as there are event times, twice."""
        tot = self._totals(betas)
        steps = {m: [np.array(tot.edge_steps(m)).reshape(-1, 2)] for m in betas}
        for part, no, v in self._read(_block_curves, (betas, tot.after)):
            at = 0
            for m in tot.models_of[part, no]:
                n = int(v[at])
                steps[m].append(v[at + 1:at + 1 + 2 * n].reshape(2, n).T)
                at += 1 + 2 * n
        out = {}
        for m, found in steps.items():
            t, dh = np.concatenate(found).T
            order = np.argsort(t, kind="stable")
            out[m] = (t[order], np.cumsum(dh[order]))
        return out

    def hazard_table(self, betas: dict, names: dict) -> DataFrame:
        """(g, time, baseline_hazard, baseline_survival): a row a model, named by ``names``, and time of its stratum."""
        import pyarrow as pa
        tot = self._totals(betas)
        spark, p = self.blocks.sparkSession, self.p
        before, inner = {}, {(part, no): v for part, no, v in self._read(_block_hazards, (betas, tot.after, [math.inf]))}
        edges, reached, taken = [], defaultdict(float), defaultdict(int)
        for part, no in tot.order:
            models = tot.models_of[part, no]
            for which in tot.edges_of[part, no]:  # its first time, what is inside, its last time
                for i, m in enumerate(models):
                    if which == "inside":
                        before[part, no, m] = reached[m]
                        reached[m] += float(inner[part, no][i]) if (part, no) in inner else 0.0
                    elif which >= taken[m]:
                        t, dh = tot.edge_steps(m, True)[which]
                        taken[m] = which + 1
                        reached[m] += dh
                        edges.append((names[m], None if t == -math.inf else float(t), reached[m], math.exp(-reached[m])))
        mine = defaultdict(list)
        for m, (s, label, efron) in enumerate(self.of):
            mine[s].append((m, label, efron))
        held = spark.sparkContext.broadcast((dict(mine), betas, tot.after, before, dict(names)))

        def run(batches):
            models, common, after, start, called = held.value
            for b in batches:
                for part, no, s, t, lab, x in zip(*(b.column(c) for c in ("part", "no", "s", "t", "lab", "x")), strict=True):
                    t = np.frombuffer(t.as_buffer(), float)
                    block = (part.as_py(), no.as_py(), s.as_py(), t, np.frombuffer(lab.as_buffer(), np.int16),
                             np.frombuffer(x.as_buffer(), float).reshape(p, len(t)))
                    for m, at, d, S0 in _inner_risk(block, models.get(block[2], []), common, after):
                        h = start[block[0], block[1], m] + np.cumsum(_quotient(d, S0))
                        yield pa.RecordBatch.from_arrays([pa.array([called[m]] * len(at), pa.string()), pa.array(at), pa.array(h), pa.array(np.exp(-h))],
                                                         names=["g", "time", "baseline_hazard", "baseline_survival"])

        schema = "g string, time double, baseline_hazard double, baseline_survival double"
        return self.blocks.mapInArrow(run, schema).unionByName(spark.createDataFrame(edges, schema))


def sorted_rows(rows: DataFrame, p: int, n: int, of: list) -> Sorted:
    """``rows``: s int, t double, lab int, x0..x{p-1} double; ``n``: about how many; ``of``: see ``Sorted``."""
    return Sorted(_packed(rows, p, n), p, list(of))


def _ends(t: np.ndarray) -> tuple[int, int]:
    """Rows of the first time, and where those of the last time begin."""
    return int(np.searchsorted(t, t[0], side="right")), int(np.searchsorted(t, t[-1], side="left"))


def _weights(x: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eta, w, x) with zeros for rows of which a covariate is missing."""
    bad = np.isnan(x).any(axis=0)
    if bad.any():
        x = np.where(bad, 0.0, x)
    eta = np.zeros(x.shape[1])
    for b, row in zip(beta, x, strict=True):
        eta += b * row
    w = np.exp(eta)
    w[bad] = 0.0
    return eta, w, x


def _moments(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of w, w x, w x x'."""
    wx = w * x
    return np.concatenate([[w.sum()], wx.sum(axis=1), (wx @ x.T).ravel()])


def _block_totals(block, models, betas) -> np.ndarray | None:
    """Its first and last time, whether they are one, rows; for each model the block's moments, then moments, events, known rows
    and events' moments of the first and of the last time, then rows, events and the sums of eta and x over events."""
    _, _, s, t, lab, x = block
    n1, n2 = _ends(t)
    out = [[t[0], t[-1], float(n1 == len(t)), float(s)]]
    known, full = t != -np.inf, ~np.isnan(x).any(axis=0)
    for m, label, _ in models:
        if m not in betas:
            continue
        eta, w, x0 = _weights(x, betas[m])
        e = lab == label
        out.append(_moments(w, x0))
        for rows in (slice(0, n1), slice(n2, len(t))):
            out.append(_moments(w[rows], x0[:, rows]))
            out.append([e[rows].sum(), full[rows].sum()])
            out.append(_moments(w[rows] * e[rows], x0[:, rows]))
        seen = e & known
        out.append([known.sum(), seen.sum(), eta[seen & full].sum()])
        out.append(x0[:, seen & full].sum(axis=1))
    return np.concatenate(out)


class _Totals:
    """What the first pass found: per model what follows each block, the times at blocks' ends, sums over rows."""

    def __init__(self, rows: Sorted, betas: dict, got: list):
        p = self.p = rows.p
        W = 1 + p + p * p
        G = 2 * W + 2
        each = W + 2 * G + 3 + p
        self.efron = {m: rows.of[m][2] for m in betas}
        mine = defaultdict(list)
        for m, (s, _, _) in enumerate(rows.of):
            if m in betas:
                mine[s].append(m)
        self.order, self.models_of, self.edges_of, self.after = [], {}, {}, {}
        self.rows = {m: [0.0, 0.0, 0.0, np.zeros(p)] for m in betas}
        self.times = defaultdict(list)  # stratum -> times at ends of blocks, in order
        own, rest = defaultdict(list), defaultdict(list)  # model -> sums of each such time, and of what comes later
        running, last = {m: np.zeros(W) for m in betas}, None
        parsed = []
        for part, no, v in got:
            head, body = v[:4], v[4:].reshape(-1, each)
            s = int(head[3])
            if last is not None and (s, head[0]) < last and not np.isnan(last[1]):
                raise RuntimeError("blocks are not in order")
            last = (s, head[1])
            parsed.append((part, no, s, head, body))
            self.order.append((part, no))
            self.models_of[part, no] = mine[s]
        for part, no, s, head, body in reversed(parsed):
            for m, b in zip(mine[s], body, strict=True):
                self.after[part, no, m] = running[m].copy()
                running[m] += b[:W]
        for part, no, s, head, body in parsed:
            first, end, single, _ = head
            places = []
            for which, t in ((0, first), (1, end)):
                if which == 1 and single:
                    break
                times = self.times[s]
                if not times or not (times[-1] == t or (np.isnan(t) and np.isnan(times[-1]))):
                    times.append(t)
                    for m in mine[s]:
                        own[m].append(np.zeros(G))
                        rest[m].append(None)
                for m, b in zip(mine[s], body, strict=True):
                    group = b[W + which * G:W + (which + 1) * G]
                    own[m][-1] += group
                    later = self.after[part, no, m]
                    rest[m][-1] = later if which == 1 or single else later + b[:W] - group[:W]
                places.append(len(times) - 1)
            self.edges_of[part, no] = places if single else [places[0], "inside", places[1]]
            for m, b in zip(mine[s], body, strict=True):
                tail = b[W + 2 * G:]
                r = self.rows[m]
                r[0], r[1], r[2], r[3] = r[0] + tail[0], r[1] + tail[1], r[2] + tail[2], r[3] + tail[3:]
        self.stratum = {m: s for s, ms in mine.items() for m in ms}
        self.own = {m: np.array(own[m]).reshape(-1, G) for m in betas}
        self.rest = {m: np.array(rest[m]).reshape(-1, W) for m in betas}

    def edge_terms(self, m) -> np.ndarray:
        """What the times at blocks' ends take from the log likelihood and the gradient, and give to the information."""
        p, own, rest = self.p, self.own[m], self.rest[m]
        W = 1 + p + p * p
        risk, events = own[:, :W] + rest, own[:, W + 2:]
        some = (own[:, W] > 0) & ((own[:, W + 1] > 0) | (not self.efron[m]))
        t = np.array(self.times[self.stratum[m]])
        a, c, L, q0, q1, q2 = efron_terms(risk[some, 0], events[some, 0], own[some, W], self.efron[m])
        unknown = (t[some] == -np.inf)[:, None]  # rows of a missing time are in no sum over rows
        at = np.where(unknown, risk[some] - own[some, :W], risk[some])
        c = np.where(unknown[:, 0], 0.0, c)
        S1, D1 = risk[some, 1:1 + p].T, events[some, 1:1 + p].T
        return np.concatenate([[L.sum()], at[:, 1:1 + p].T @ a - D1 @ c,
                               (a @ at[:, 1 + p:] - c @ events[some, 1 + p:]) - _spread(S1, D1, q0, q1, q2).ravel()])

    def edge_steps(self, m, all_times: bool = False) -> list:
        """(time, increment of the baseline hazard) at the times at blocks' ends."""
        W = 1 + self.p + self.p * self.p
        dh = _quotient(self.own[m][:, W], self.own[m][:, 0] + self.rest[m][:, 0])
        return [(t, float(h)) for t, h in zip(self.times[self.stratum[m]], dh, strict=True) if all_times or h > 0]


def _quotient(d: np.ndarray, S0: np.ndarray) -> np.ndarray:
    return np.divide(d, S0, out=np.zeros(len(d)), where=(d > 0) & (S0 > 0))


def _spread(S1, D1, q0, q1, q2) -> np.ndarray:
    cross = (S1 * q1) @ D1.T
    return (S1 * q0) @ S1.T - cross - cross.T + (D1 * q2) @ D1.T


def _block_steps(block, models, shared) -> np.ndarray | None:
    """``edge_terms`` of the times inside the block, a row a model."""
    betas, after = shared
    part, no, _, t, lab, x = block
    n1, n2 = _ends(t)
    if n1 >= n2:
        return None
    p, out = len(x), []
    inside = t[n1:n2]
    at = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
    sizes = np.diff(np.append(at, len(inside)))
    full = np.add.reduceat(~np.isnan(x[:, n1:n2]).any(axis=0), at, dtype=np.int64) > 0
    for m, label, efron in models:
        if m not in betas:
            continue
        _, w, x0 = _weights(x, betas[m])
        rest = after[part, no, m] + _moments(w[n2:], x0[:, n2:])
        w, x0, e = w[n1:n2], x0[:, n1:n2], lab[n1:n2] == label
        d = np.add.reduceat(e, at, dtype=np.int64)
        some = np.flatnonzero((d > 0) & (full | (not efron)))
        S0 = np.cumsum(np.add.reduceat(w, at)[::-1])[::-1][some] + rest[0]
        wx = w * x0
        S1 = np.cumsum(np.add.reduceat(wx, at, axis=1)[:, ::-1], axis=1)[:, ::-1][:, some] + rest[1:1 + p, None]
        D0, D1 = np.add.reduceat(w * e, at)[some], np.add.reduceat(wx * e, at, axis=1)[:, some]
        a, c, L, q0, q1, q2 = efron_terms(S0, D0, d[some].astype(float), efron)
        every = np.zeros((2, len(at)))
        every[:, some] = a, c
        A, of_events = np.repeat(np.cumsum(every[0]), sizes), np.repeat(every[1], sizes)
        info = (wx * (A - e * of_events)) @ x0.T + a.sum() * rest[1 + p:].reshape(p, p) - _spread(S1, D1, q0, q1, q2)
        out.append(np.concatenate([[L.sum()], S1 @ a - D1 @ c, info.ravel()]))
    return np.concatenate(out) if out else None


def _inner_risk(block, models, betas, after):
    """(model, times inside the block, events, S0) of each model."""
    part, no, _, t, lab, x = block
    n1, n2 = _ends(t)
    if n1 >= n2:
        return
    inside = t[n1:n2]
    at = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
    for m, label, _ in models:
        if m in betas:
            _, w, _ = _weights(x, betas[m])
            d = np.add.reduceat(lab[n1:n2] == label, at, dtype=np.int64)
            yield m, inside[at], d, np.cumsum(np.add.reduceat(w[n1:n2], at)[::-1])[::-1] + w[n2:].sum() + after[part, no, m][0]


def _block_hazards(block, models, shared) -> np.ndarray | None:
    betas, after, times = shared
    found = [[dh[t <= u].sum() for u in times] for _, t, d, S0 in _inner_risk(block, models, betas, after) for dh in [_quotient(d, S0)]]
    return np.array(found).ravel() if found else None


def _block_curves(block, models, shared) -> np.ndarray | None:
    out = []
    for _, t, d, S0 in _inner_risk(block, models, *shared):
        some = d > 0
        out += [[some.sum()], t[some], _quotient(d, S0)[some]]
    return np.concatenate(out) if out else None


def newton(stats: Callable[[dict], dict], models: Sequence[int], p: int, penalty: Callable, max_iter: int = 25, tol: float = 1e-9,
           singular: str = "skip") -> dict:
    """Newton steps with halvings of all models side by side: {model: (beta, log likelihood, that at 0, information with
    its penalty's, rows, events, steps)}.  ``stats``: as ``Sorted.stats``; ``penalty(m, beta, n)``: value, gradient and Hessian.
    A model whose step is singular is left out, or steps by the pseudo-inverse (``singular="pinv"``)."""
    beta = {m: np.zeros(p) for m in models}
    cur = stats(beta)
    pen = {m: penalty(m, beta[m], cur[m][3]) for m in cur}
    null, obj = {m: v[0] for m, v in cur.items()}, {m: v[0] - pen[m][0] for m, v in cur.items()}
    active, failed, steps = set(cur), set(), {}
    shrink, done = dict.fromkeys(cur, 1.0), dict.fromkeys(cur, 0)
    while active:
        for m in sorted(active - steps.keys()):
            H, g = cur[m][2] + pen[m][2], cur[m][1] - pen[m][1]
            try:
                steps[m] = np.linalg.solve(H, g)
            except np.linalg.LinAlgError:
                if singular == "pinv":
                    steps[m] = np.linalg.pinv(H) @ g
                else:
                    failed.add(m)
        active -= failed
        if not active:
            break
        cand = {m: beta[m] + shrink[m] * steps[m] for m in sorted(active)}
        new = stats(cand)  # finished models rest
        for m in sorted(active):
            after = penalty(m, cand[m], new[m][3])
            o = new[m][0] - after[0]
            if np.isfinite(o) and o >= obj[m] - 1e-12 * abs(obj[m]):
                gain, move = o - obj[m], float(np.max(np.abs(shrink[m] * steps[m]), initial=0.0))
                beta[m], cur[m], pen[m], obj[m] = cand[m], new[m], after, o
                done[m] += 1
                steps.pop(m)
                shrink[m] = 1.0
                if abs(gain) <= tol * max(1.0, abs(o)) or move < 1e-10 or done[m] >= max_iter:
                    active.discard(m)
            else:
                shrink[m] *= 0.5
                if shrink[m] < 1e-6:
                    active.discard(m)
    return {m: (beta[m], cur[m][0], null[m], cur[m][2] + pen[m][2], cur[m][3], cur[m][4], done[m]) for m in cur if m not in failed}
