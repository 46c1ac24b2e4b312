"""Markov chains with normal emissions over long series: switching means and variances, hidden states, two levels.

A step of the filter is linear: the state's weights times the transition matrix times the densities of the row. So a block
of rows is one small matrix, blocks are composed in a scan over their matrices, and every block then filters and smooths
its own rows from the weights that enter it on both sides. One long series is as many tasks as it has blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import saved


@dataclass(frozen=True)
class Chain:
    """start: of each state. move: from state to state. mean, cov: of the emissions by state."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    cov: np.ndarray


def _log_densities(x: np.ndarray, c: Chain) -> np.ndarray:
    out = np.empty((len(x), len(c.start)))
    for k, (m, s) in enumerate(zip(c.mean, c.cov, strict=True)):
        root = np.linalg.cholesky(s)
        z = np.linalg.solve(root, (x - m).T)
        out[:, k] = -0.5 * (z * z).sum(0) - np.log(np.diag(root)).sum() - 0.5 * len(m) * np.log(2 * np.pi)
    return out


def _product(logs: np.ndarray, c: Chain, first: bool) -> tuple[np.ndarray, float]:
    """The block's matrix and the logarithm it is scaled by; a series' first row has no step before it."""
    top = logs.max(1)
    p, scale = c.move[None] * np.exp(logs - top[:, None])[:, None, :], top.copy()
    if first:
        p[0] = np.diag(np.exp(logs[0] - top[0]))
    while len(p) > 1:
        if len(p) % 2:
            p, scale = np.concatenate([p, np.eye(len(c.start))[None]]), np.append(scale, 0.0)
        p, scale = p[0::2] @ p[1::2], scale[0::2] + scale[1::2]
        norm = np.maximum(p.max((1, 2)), 1e-300)
        p, scale = p / norm[:, None, None], scale + np.log(norm)
    return p[0], float(scale[0])


def _passes(logs: np.ndarray, c: Chain, first: bool, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filtered and smoothed weights of a block's rows and the expected moves into them, given the weights that enter it
    from before and from behind."""
    n, k = logs.shape
    b = np.exp(logs - logs.max(1, keepdims=True))
    ahead, back = np.empty((n, k)), np.empty((n, k))
    a = enter
    for t in range(n):
        a = (a if first and t == 0 else a @ c.move) * b[t]
        a = ahead[t] = a / a.sum()
    v = leave / leave.sum()
    for t in range(n - 1, -1, -1):
        back[t] = v
        v = c.move @ (b[t] * v)
        v = v / v.sum()
    smooth = ahead * back
    smooth /= smooth.sum(1, keepdims=True)
    before = np.concatenate([enter[None], ahead[:-1]])
    moves = before[:, :, None] * c.move * (b * back)[:, None, :]
    moves /= np.maximum(moves.sum((1, 2), keepdims=True), 1e-300)
    return ahead, smooth, moves[1:] if first else moves


def _keyed(df: DataFrame, columns: list[str], block: int) -> DataFrame:
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    rows = df.select("symbol", F.col("row_id").cast("long").alias("row_id"), x.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    return rows.withColumn("block", F.floor(F.col("row_id") / block))


def _arrays(table: pa.Table) -> tuple[str, int, np.ndarray, np.ndarray]:
    table = table.sort_by("row_id")
    x = table["x"].combine_chunks()
    return table["symbol"][0].as_py(), table["block"][0].as_py(), table["row_id"].to_numpy(), x.flatten().to_numpy().reshape(len(x), -1)


def _starts(rows: DataFrame, states: int, width: int) -> dict[str, tuple[Chain, np.ndarray]]:
    """First chains per symbol: states by quantiles of the first column, and the whole covariance that bounds theirs."""
    cuts = rows.groupBy("symbol").agg(F.percentile_approx(F.col("x")[0], F.array(*[F.lit(i / states) for i in range(1, states)]), 10_000).alias("q"))
    parts = rows.join(F.broadcast(cuts), "symbol").withColumn("state", F.size(F.filter("q", lambda q: F.col("x")[0] > q)))
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    found: dict[str, dict] = {}
    for r in parts.groupBy("symbol", "state").agg(F.count("*").alias("n"), *sums).collect():  # a row a symbol and state
        found.setdefault(r.symbol, {})[r.state] = r
    out = {}
    for symbol, by in found.items():
        n = sum(r.n for r in by.values())
        mean = np.array([sum(r[f"s{i}"] for r in by.values()) for i in range(width)]) / n
        cov = np.array([[sum(r[f"p{min(i, j)}_{max(i, j)}"] for r in by.values()) for j in range(width)] for i in range(width)]) / n - np.outer(mean, mean)
        cov += np.eye(width) * max(1e-12, 1e-6 * np.trace(cov) / width)
        means = np.array([[by[k][f"s{i}"] / by[k].n for i in range(width)] if k in by else mean for k in range(states)])
        move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        out[symbol] = (Chain(np.full(states, 1 / states), move, means, np.array([cov / states] * states)), cov)
    return out


def _edges(rows: DataFrame, chains: dict[str, Chain]) -> tuple[dict, dict[str, float]]:
    """The weights that enter each block from both sides and the log-likelihood per symbol: blocks' matrices are made by
    tasks, and composed here, a small matrix a block."""
    sent = rows.sparkSession.sparkContext.broadcast(chains)

    def product(table: pa.Table) -> pa.Table:
        symbol, block, ids, x = _arrays(table)
        c = sent.value[symbol]
        whole, rest = _product(_log_densities(x, c), c, False), _product(_log_densities(x, c), c, True)
        return pa.table({"symbol": [symbol], "block": pa.array([block], pa.int64()), "whole": [whole[0].ravel().tolist()], "rest": [rest[0].ravel().tolist()], "scales": [[whole[1], rest[1]]]})

    made = rows.groupBy("symbol", "block").applyInArrow(product, "symbol string, block long, whole array<double>, rest array<double>, scales array<double>").toArrow().sort_by([("symbol", "ascending"), ("block", "ascending")]).to_pylist()
    by: dict[str, list] = {}
    for r in made:
        by.setdefault(r["symbol"], []).append(r)
    edges, likely = {}, {}
    for symbol, blocks in by.items():
        c, total = chains[symbol], 0.0
        k, v, back = len(c.start), c.start, np.ones(len(c.start))
        mats = [np.array(b["whole" if i else "rest"]).reshape(k, k) for i, b in enumerate(blocks)]
        leaves = [back]
        for m in mats[:0:-1]:
            back = m @ back
            leaves.append(back := back / back.sum())
        for i, (b, m, leave) in enumerate(zip(blocks, mats, leaves[::-1], strict=True)):
            edges[symbol, b["block"]] = (i == 0, v, leave)
            v = v @ m
            total += b["scales"][0 if i else 1] + np.log(v.sum())
            v = v / v.sum()
        likely[symbol] = float(total)
    return edges, likely


def _summed(sent):
    """What makes a block's expected counts, moments and moves, in one list of numbers."""

    def stats(table: pa.Table) -> pa.Table:
        symbol, block, ids, x = _arrays(table)
        c, (head, enter, leave) = sent.value[0][symbol], sent.value[1][symbol, block]
        _, g, moves = _passes(_log_densities(x, c), c, head, enter, leave)
        second = np.einsum("tk,ti,tj->kij", g, x, x)
        out = np.concatenate([g.sum(0), (g.T @ x).ravel(), second.ravel(), moves.sum(0).ravel(), g[0] if head else np.zeros(g.shape[1])])
        return pa.table({"symbol": [symbol], "i": pa.array([range(len(out))], pa.list_(pa.int32())), "v": [out.tolist()]})

    return stats


def fit_chains(df: DataFrame, columns: list[str], states: int = 2, rounds: int = 50, tolerance: float = 1e-6, block: int = 10_000) -> tuple[dict[str, Chain], DataFrame]:
    """Chains per symbol by expectation maximisation, and the rows they were fitted on, by block. Rounds end when the
    log-likelihood per row of every symbol gains less than the tolerance. Each round is two passes over the blocks; rows with
    a null or NaN are left out; blocks are ranges of row_id."""
    rows = saved(_keyed(df, columns, block), "chains")
    first = _starts(rows, states, len(columns))
    chains, least = {s: c for s, (c, _) in first.items()}, {s: v * 1e-3 for s, (_, v) in first.items()}
    sizes = {r.symbol: r.n for r in rows.groupBy("symbol").agg(F.count("*").alias("n")).collect()}  # a row a symbol
    before: dict[str, float] = {}
    for _ in range(rounds):
        if not chains:
            break
        edges, likely = _edges(rows, chains)
        if before and all(likely[s] - before[s] < tolerance * sizes[s] for s in likely):
            break
        before, sent = likely, rows.sparkSession.sparkContext.broadcast((chains, edges))

        sums = rows.groupBy("symbol", "block").applyInArrow(_summed(sent), "symbol string, i array<int>, v array<double>")
        sums = sums.select("symbol", F.explode(F.arrays_zip("i", "v")).alias("z")).groupBy("symbol", "z.i").agg(F.sum("z.v").alias("v"))
        told: dict[str, dict[int, float]] = {}
        for r in sums.collect():  # a few numbers a symbol
            told.setdefault(r.symbol, {})[r.i] = r.v
        k, d = states, len(columns)
        for symbol, v in told.items():
            v = np.array([v[i] for i in range(len(v))])
            n, m, s, move, start = np.split(v, np.cumsum([k, k * d, k * d * d, k * k]))
            n = np.maximum(n, 1e-9)
            mean = m.reshape(k, d) / n[:, None]
            cov = s.reshape(k, d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
            cov = (cov + cov.transpose(0, 2, 1)) / 2 + np.diag(np.diag(least[symbol]))
            move = move.reshape(k, k) + 1e-12
            chains = chains | {symbol: Chain(start / start.sum(), move / move.sum(1, keepdims=True), mean, cov)}
    return chains, rows


def chain_states(rows: DataFrame, chains: dict[str, Chain]) -> DataFrame:
    """symbol, row_id, filtered, smoothed (weights by state) and state, the likeliest smoothed one, the first of ties."""
    if not chains:
        return rows.sparkSession.createDataFrame([], "symbol string, row_id long, filtered array<double>, smoothed array<double>, state int")
    edges, _ = _edges(rows, chains)
    sent = rows.sparkSession.sparkContext.broadcast((chains, edges))

    def run(table: pa.Table) -> pa.Table:
        symbol, block, ids, x = _arrays(table)
        c, (head, enter, leave) = sent.value[0][symbol], sent.value[1][symbol, block]
        ahead, smooth, _ = _passes(_log_densities(x, c), c, head, enter, leave)
        return pa.table({"symbol": [symbol] * len(ids), "row_id": ids, "filtered": ahead.tolist(), "smoothed": smooth.tolist(), "state": pa.array(smooth.argmax(1).astype(np.int32))})

    return rows.groupBy("symbol", "block").applyInArrow(run, "symbol string, row_id long, filtered array<double>, smoothed array<double>, state int")


def switching_regimes(df: DataFrame, column: str, states: int = 2, rounds: int = 50, tolerance: float = 1e-6, block: int = 10_000) -> DataFrame:
    """Markov-switching regression on a constant with switching variance: weights and labels per row. States are in the
    order of the first quantiles, so 0 has the least mean to begin with."""
    chains, rows = fit_chains(df, [column], states, rounds, tolerance, block)
    return chain_states(rows, chains)


def _best_product(logs: np.ndarray, c: Chain, first: bool) -> np.ndarray:
    """The best log weight from each state before the block to each state at its end."""
    with np.errstate(divide="ignore"):
        p = np.log(c.move)[None] + logs[:, None, :]
        if first:
            p[0] = np.where(np.eye(len(c.start)) > 0, logs[0][:, None], -np.inf)
        none = np.log(np.eye(len(c.start)))
    while len(p) > 1:
        p = np.concatenate([p, none[None]]) if len(p) % 2 else p
        p = (p[0::2, :, :, None] + p[1::2, None, :, :]).max(2)
    return p[0]


def _best_path(logs: np.ndarray, c: Chain, first: bool, enter: int, leave: int) -> np.ndarray:
    """The likeliest states of a block's rows between the state before it and its last one."""
    with np.errstate(divide="ignore"):
        move = np.log(c.move)
    n, k = logs.shape
    came, v = np.zeros((n, k), np.int32), np.full(k, -np.inf)
    v[enter] = 0.0
    for t in range(n):
        if first and t == 0:
            v = v + logs[0]
            continue
        step = v[:, None] + move
        came[t] = step.argmax(0)
        v = step.max(0) + logs[t]
    path, state = np.empty(n, np.int32), leave
    for t in range(n - 1, -1, -1):
        path[t], state = state, came[t, state]
    return path


def likeliest_states(rows: DataFrame, chains: dict[str, Chain]) -> DataFrame:
    """symbol, row_id and state of the likeliest path of states. Blocks give their best weights from state to state, the
    states at their borders are chosen in a scan over blocks, and every block finds its own part."""
    if not chains:
        return rows.sparkSession.createDataFrame([], "symbol string, row_id long, state int")
    sc = rows.sparkSession.sparkContext
    sent = sc.broadcast(chains)

    def product(table: pa.Table) -> pa.Table:
        symbol, block, _, x = _arrays(table)
        c = sent.value[symbol]
        logs = _log_densities(x, c)
        return pa.table({"symbol": [symbol], "block": pa.array([block], pa.int64()), "whole": [_best_product(logs, c, False).ravel().tolist()], "rest": [_best_product(logs, c, True).ravel().tolist()]})

    made = rows.groupBy("symbol", "block").applyInArrow(product, "symbol string, block long, whole array<double>, rest array<double>").toArrow().sort_by([("symbol", "ascending"), ("block", "ascending")]).to_pylist()
    by: dict[str, list] = {}
    for r in made:
        by.setdefault(r["symbol"], []).append(r)
    borders = {}
    for symbol, blocks in by.items():
        k = len(chains[symbol].start)
        with np.errstate(divide="ignore"):
            v = np.log(chains[symbol].start)
        seen = []
        for i, b in enumerate(blocks):
            step = v[:, None] + np.array(b["whole" if i else "rest"]).reshape(k, k)
            seen.append(step)
            v = step.max(0)
        state = int(v.argmax())
        for i in range(len(blocks) - 1, -1, -1):
            enter = int(seen[i][:, state].argmax())
            borders[symbol, blocks[i]["block"]] = (i == 0, enter, state)
            state = enter
    told = sc.broadcast((chains, borders))

    def run(table: pa.Table) -> pa.Table:
        symbol, block, ids, x = _arrays(table)
        c = told.value[0][symbol]
        return pa.table({"symbol": [symbol] * len(ids), "row_id": ids, "state": pa.array(_best_path(_log_densities(x, c), c, *told.value[1][symbol, block]))})

    return rows.groupBy("symbol", "block").applyInArrow(run, "symbol string, row_id long, state int")


def hierarchical_states(df: DataFrame, primary: str, secondary: str, primary_states: int = 2, secondary_states: int = 3, rounds: int = 50, block: int = 10_000) -> DataFrame:
    """symbol, row_id, primary_state, secondary_state and nested_state: likeliest states of a chain over one column, and
    within each of its states those of a chain over another column, fitted on that state's rows in their order. A state
    with at most five rows a secondary state has the secondary state 0. Secondary states count on from state to state."""
    chains, rows = fit_chains(df, [primary], primary_states, rounds, block=block)
    first = saved(likeliest_states(rows, chains), "primary")
    inner = df.join(first.withColumnRenamed("state", "primary_state"), ["symbol", "row_id"])
    inner = saved(inner.select(F.concat_ws("|", "primary_state", "symbol").alias("symbol"), "row_id", secondary), "secondary")
    enough = inner.groupBy("symbol").agg(F.count(secondary).alias("n")).where(F.col("n") > 5 * secondary_states)
    chains, rows = fit_chains(inner.join(F.broadcast(enough.select("symbol")), "symbol"), [secondary], secondary_states, rounds, block=block)
    below = likeliest_states(rows, chains).select(F.substring_index("symbol", "|", 1).cast("int").alias("state"), F.expr("substring(symbol, instr(symbol, '|') + 1)").alias("symbol"), "row_id", F.col("state").alias("sub"))
    out = first.join(below, ["symbol", "row_id", "state"], "left").withColumn("sub", F.coalesce("sub", F.lit(0)))
    nested = F.col("state") * secondary_states + F.col("sub")
    return out.select("symbol", "row_id", F.col("state").alias("primary_state"), nested.alias("secondary_state"), nested.alias("nested_state"))
