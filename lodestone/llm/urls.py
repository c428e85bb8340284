"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Rules (host/path, allow or block) fit a host and its subdomains where the url's path starts with the rule's; the
longest fitting rule decides.  Urls that a rule decides are labels: a bounded sample of them trains boosted trees on
length, depth, digit ratio, entropy, parameter counts, host shape and suffix statistics, and the trees judge the urls
that no rule fits.

Suffix statistics say how often urls that share a part of the url are blocked: the last one, two or three labels of the
host, the first directory of the path, and the suffix of its last name.  They are counted over all labelled urls of
*other* hosts (cross-fitted: a host never speaks for itself, as it cannot for an unlisted host), and drawn to the share
of all labelled urls by WEIGHT imagined urls, so a part that is new says nothing.  Rules label whole suffixes, and the
trees must judge suffixes that no rule names; so each labelled url is also learned from as if its host's parts were new.

Nulls and ties: a null url, or one without ``://``, has host and path '' and fits no rule; the trees judge it.  Repeated
rows get equal verdicts; an empty table gives an empty result; very long urls are read whole.
Without labelled urls of both kinds, every url without a rule gets the commoner verdict (allow if there is none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column, joined_evenly, pieces, small_batches, text_bytes
from lodestone.storage import importable, materialize

#: The production rules: (rule, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: At most this many labelled urls of each verdict train the trees.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 40, 3, 32, 0.2, 20
#: Imagined urls of the common share in each suffix statistic, and held-out parts of the hosts in ``held_out_auc``.
WEIGHT, FOLDS = 10.0, 5
#: Parts of a url that have statistics: labels at the host's end, first directory, suffix of the last name.
PARTS = ("host1", "host2", "host3", "dir", "ext")
FEATURES = (
    "length", "depth", "digit_ratio", "entropy", "parameters", "host_length", "host_labels", "hyphens", "path_length", "fragment",
    *(f"{p}_{x}" for p in PARTS for x in ("blocked", "labelled")),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both '' if it is null or has no ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.substring(F.col(url), at + 3, F.length(url))
    whole = at > 0
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(whole, host), F.lit("")), F.coalesce(F.when(whole, path), F.lit(""))


def rule_columns(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (host, path), and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, _, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


# -- features -------------------------------------------------------------------------------------------------------


def lexical(batch: pa.RecordBatch) -> np.ndarray:
    """The feature matrix of a batch with url, host, path and suffix statistics."""
    data, offsets = text_bytes(column(batch, "url"))
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1)
    count = lambda mask: np.bincount(row[mask], minlength=n).astype(float)
    counts = np.zeros((n, 256))
    np.add.at(counts, (row, data), 1)
    share = counts / size[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    queries = count(data == ord("?")) > 0
    hosts, at = text_bytes(column(batch, "host"))
    host_row = np.repeat(np.arange(n), np.diff(at))
    paths, path_at = text_bytes(column(batch, "path"))
    path_row = np.repeat(np.arange(n), np.diff(path_at))
    said = [column(batch, f"{p}_{x}").to_numpy(zero_copy_only=False).astype(float) for p in PARTS for x in ("blocked", "labelled")]
    return np.column_stack([
        np.diff(offsets), np.bincount(path_row[paths == ord("/")], minlength=n), count((data >= 48) & (data <= 57)) / size, entropy,
        queries + count(data == ord("&")), np.diff(at), np.bincount(host_row[hosts == ord(".")], minlength=n), count(data == ord("-")), np.diff(path_at), count(data == ord("#")) > 0,
        *said,
    ]).astype(float)


def url_parts() -> list[Column]:
    """The parts of (host, path) that have statistics."""
    last = F.element_at(F.split("path", "/"), -1)
    return [
        *(F.substring_index("host", ".", -k).alias(f"host{k}") for k in (1, 2, 3)), F.regexp_extract("path", "^/([^/]+)/", 1).alias("dir"),
        F.lower(F.regexp_extract(last, r"\.([^.]+)$", 1)).alias("ext"),
    ]


def suffix_statistics(base: DataFrame) -> tuple[DataFrame, float]:
    """The blocked share of all labelled urls; and per (host, dir, ext) of the urls: how many there are (``seen``), and per part its blocked share and the number
    (log) of labelled urls of other hosts that have the part.

    Urls are counted by (host, dir, ext) first, so the parts' totals are sums over a table of hosts, and a part that a
    third of all hosts have is no hot task.
    """
    sums = [F.sum(c).alias(c) for c in ("seen", "labels", "blocks")]
    counts = base.groupBy("host", "dir", "ext", "host1", "host2", "host3").agg(
        F.count(F.lit(1)).alias("seen"), F.count("ruled").alias("labels"), F.count_if(F.col("ruled") == "block").alias("blocks"),
    )
    counts = materialize(counts, "url-counts")
    blocked, labelled = counts.agg(F.sum("blocks"), F.sum("labels")).first()
    common = (blocked or 0) / labelled if labelled else 0.0

    def said(rows: DataFrame, part: str) -> DataFrame:
        """``rows`` (labels, blocks of one host) with the part's statistics over the other hosts."""
        total = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"), F.sum("labels").alias("_labels"), F.sum("blocks").alias("_blocks"))
        n, b = F.col("_labels") - F.col("labels"), F.col("_blocks") - F.col("blocks")
        found = joined_evenly(rows, materialize(total, f"url-{part}"), [part], "_n")
        return found.withColumns({f"{part}_blocked": (b + WEIGHT * common) / (n + WEIGHT), f"{part}_labelled": F.log1p(n)}).drop("_labels", "_blocks")

    hosts = materialize(counts.groupBy("host", "host1", "host2", "host3").agg(*sums), "url-hosts")
    for part in PARTS[:3]:
        hosts = said(hosts, part)
    out = counts.select("host", "dir", "ext", "seen")
    tables = [(["host"], materialize(hosts.select("host", *(f"{p}_{x}" for p in PARTS[:3] for x in ("blocked", "labelled"))), "url-host-statistics"))]
    for part in PARTS[3:]:
        own = said(materialize(counts.groupBy("host", part).agg(*sums), f"url-host-{part}"), part)
        tables.append((["host", part], materialize(own.select("host", part, f"{part}_blocked", f"{part}_labelled"), f"url-{part}-statistics")))
    for keys, table in tables:
        of = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        out = joined_evenly(out, materialize(table.join(of, keys), "url-statistics"), keys, "_n")
    return materialize(out, "url-statistics"), common


# -- trees ----------------------------------------------------------------------------------------------------------


def fit_trees(x: np.ndarray, y: np.ndarray) -> tuple[float, list[list[tuple[int, float, float]]]]:
    """Boosted trees for the log odds of y (0 or 1): a start value and per tree its nodes (feature, threshold, value),
    children of node i at 2i+1 and 2i+2; feature -1 is a leaf.  Values up to a threshold go left."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    score, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - p, p * (1 - p)
        nodes = [(-1, 0.0, 0.0)] * (2 ** (DEPTH + 1) - 1)
        members = {0: np.arange(len(y))}
        for node in range(len(nodes)):
            at = members.pop(node, None)
            if at is None:
                continue
            g, h = gradient[at].sum(), weight[at].sum()
            best = (1e-6, -1, 0)
            if 2 * node + 2 < len(nodes):
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[at, j]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, minlength=len(e) + 1))[:-1] for w in (gradient[at], weight[at], np.ones(len(at))))
                    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                    gain[(ns < LEAST_LEAF) | (len(at) - ns < LEAST_LEAF)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] < 0:
                value = RATE * g / (h + 1)
                nodes[node] = (-1, 0.0, float(value))
                score[at] += value
            else:
                _, j, k = best
                nodes[node] = (j, float(edges[j][k]), 0.0)
                left = binned[at, j] <= k
                members[2 * node + 1], members[2 * node + 2] = at[left], at[~left]
        trees.append(nodes)
    return start, trees


def tree_scores(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    """Probabilities of y = 1."""
    start, trees = model
    score = np.full(len(x), start)
    for nodes in trees:
        feature, threshold, value = (np.array(c) for c in zip(*nodes))
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = feature[node]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        score += value[node]
    return 1 / (1 + np.exp(-score))


def auc(p: np.ndarray, y: np.ndarray) -> float:
    """The chance that a blocked url (y = 1) scores above an allowed one, ties half."""
    values, at = np.unique(p, return_inverse=True)
    counts = np.bincount(at, minlength=len(values))
    rank = np.cumsum(counts) - (counts - 1) / 2
    ones = y.sum()
    return float((rank[at][y > 0].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones)))


def unseen(x: np.ndarray, share: float) -> np.ndarray:
    """The features as they were if the parts of the host were new."""
    out = x.copy()
    for p in PARTS[:3]:
        out[:, FEATURES.index(f"{p}_blocked")], out[:, FEATURES.index(f"{p}_labelled")] = share, 0
    return out


def url_model(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, list]:
    """Trees from labelled urls, each also as a url of new host parts."""
    return fit_trees(np.concatenate([x, unseen(x, share)]), np.concatenate([y, y]))


def held_out_auc(x: np.ndarray, y: np.ndarray, hosts: np.ndarray, share: float) -> tuple[float, float]:
    """AUC on the urls of hosts that the trees have not seen, and the same if those hosts' parts were new too.  Each of FOLDS
    parts of the hosts is held out once."""
    fold = np.array([zlib.crc32(h.encode()) % FOLDS for h in hosts])
    known, new = np.zeros(len(y)), np.zeros(len(y))
    for k in range(FOLDS):
        own = fold == k
        model = url_model(x[~own], y[~own], share)
        known[own], new[own] = tree_scores(model, x[own]), tree_scores(model, unseen(x[own], share))
    return auc(known, y), auc(new, y)


def labelled_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray, float]:
    """The urls with all features' columns; of the sample that trains the trees: features, labels (1: block) and hosts; and
    the blocked share of all labelled urls."""
    host, path = host_and_path("url")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("ruled"), *url_parts())
    statistics, share = suffix_statistics(base)
    rows = joined_evenly(base.drop("host1", "host2", "host3"), statistics, ["host", "dir", "ext"], "seen")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([column(b, "host"), pa.array(list(lexical(b)), pa.list_(pa.float64()))], names=["host", "x"])

    with small_batches(pages.sparkSession):
        drawn = [rows.where(F.col("ruled") == v).orderBy(
            F.xxhash64("url", "page_id"), "url", "page_id",
        ).limit(sample).mapInArrow(featured, "host string, x array<double>").toArrow() for v in ("allow", "block")]
    x = [np.array(t.column("x").to_pylist(), float).reshape(-1, len(FEATURES)) for t in drawn]
    hosts = np.array([h for t in drawn for h in t.column("host").to_pylist()], object)
    return rows, np.concatenate(x), np.repeat([0.0, 1.0], [len(v) for v in x]), hosts, share


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, host, path, rule, verdict and blocked (the trees' probability, null where a rule decides)."""
    importable(pages.sparkSession)
    rows, x, y, _, share = labelled_urls(pages, rules, sample)
    model = url_model(x, y, share) if 0 < y.sum() < len(y) else None
    constant = float(2 * y.sum() > len(y))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ruled = column(b, "ruled").to_pylist()
            p = tree_scores(model, lexical(b)) if model else np.full(b.num_rows, constant)
            verdicts = [r or ("block" if v >= 0.5 else "allow") for r, v in zip(ruled, p)]
            yield pa.RecordBatch.from_arrays(
                [*(column(b, c) for c in ("page_id", "url", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array([None if r else float(v) for r, v in zip(ruled, p)], pa.float64())],
                names=["page_id", "url", "host", "path", "rule", "verdict", "blocked"],
            )

    return rows.mapInArrow(judge, "page_id long, url string, host string, path string, rule string, verdict string, blocked double")
