"""Operator 13, secret scans: base patterns, and probabilistic automata inferred from labelled credentials.

For each format of credentials, and each class of ordinary tokens, labelled strings make a prefix tree with counts. States are merged
where their futures are statistically compatible (Hoeffding's bound on every arc, and on those below), which folds what is
random into loops and keeps what is fixed as chains: a probabilistic automaton. Every candidate, a run of credential characters, is
scored by all automata: the log of its likelihood as a format less that as the likeliest class of ordinary tokens. Fitting is done on the driver
from a bounded set of labelled strings; scoring in tasks, all candidates of a batch in step.
"""

from __future__ import annotations

import base64
import bisect
import functools
import importlib.util
import itertools
import json
import math
import random
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A greedy run is a maximal one, so asking for its length in the pattern is asking it of the match.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")

#: Candidates: maximal runs of credential characters, without points at their ends; within them, what stands between signs of equality, with those that pad it, and maximal runs of a narrower class.
CANDIDATE, WITHIN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}"), (re.compile(r"[A-Za-z0-9+/_.-]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}"))
SHORTEST = 16
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_ALNUM = _ALPHABET[:62]

#: Labelled credentials a format, and ordinary tokens, that the automata are fitted on at most.
LABELLED, ORDINARY = 160, 3600
#: Of ordinary tokens set apart, at most this share may reach the threshold, which is LEAST_RATIO at least.
FALSE_SHARE, LEAST_RATIO = 0.0005, 12.0
#: Modules of the standard library whose source gives ordinary tokens.
SOURCES = "argparse ast asyncio.events calendar codecs configparser csv datetime decimal doctest email.message ftplib http.client imaplib inspect locale logging mailbox mimetypes optparse pathlib pdb pickletools platform plistlib poplib pydoc shutil smtplib socket ssl statistics subprocess tarfile threading typing unittest.mock urllib.request uuid webbrowser xml.dom.minidom xmlrpc.client zipfile".split()


def _some(rng: random.Random, n: int, of: str = _ALNUM) -> str:
    return "".join(rng.choices(of, k=n))


def _url_base64(value: object) -> str:
    return base64.urlsafe_b64encode(json.dumps(value, separators=(",", ":")).encode()).decode().rstrip("=")


def _signed_claims(rng: random.Random) -> str:
    head = {"alg": rng.choice(["HS256", "RS256", "ES256", "HS512"]), "typ": "JWT"}
    if rng.random() < 0.3:
        head["kid"] = _some(rng, rng.choice([6, 20]))
    claims = {rng.choice(["sub", "iss", "user_id"]): _some(rng, rng.randrange(4, 30)), "iat": rng.randrange(10**9, 2 * 10**9)}
    if rng.random() < 0.6:
        claims["exp"] = rng.randrange(10**9, 2 * 10**9)
    if rng.random() < 0.3:
        claims["email"] = f"{_some(rng, 6).lower()}@example.com"
    return ".".join([_url_base64(head), _url_base64(claims), _some(rng, rng.choice([43, 86]), _ALNUM + "_-")])


#: Public formats of credentials. Each makes one labelled example.
FORMATS = {
    "aws": lambda r: r.choice(["ASIA", "ABIA", "ACCA"]) + _some(r, 16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "github": lambda r: r.choice(["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]) + _some(r, 36) if r.random() < 0.8 else f"github_pat_{_some(r, 22)}_{_some(r, 59)}",
    "gitlab": lambda r: "glpat-" + _some(r, 20, _ALNUM + "_-"),
    "google": lambda r: "AIza" + _some(r, 35, _ALNUM + "_-"),
    "jwt": _signed_claims,
    "npm": lambda r: "npm_" + _some(r, 36),
    "sendgrid": lambda r: f"SG.{_some(r, 22, _ALNUM + '_-')}.{_some(r, 43, _ALNUM + '_-')}",
    "slack": lambda r: f"{r.choice(['xoxb', 'xoxp', 'xoxa'])}-{_some(r, r.randrange(10, 14), '0123456789')}-{_some(r, r.randrange(10, 14), '0123456789')}-{_some(r, 24)}",
    "stripe": lambda r: f"{r.choice(['sk', 'rk', 'pk'])}_{r.choice(['live', 'test'])}_{_some(r, r.choice([24, 99]))}",
    "random": lambda r: r.choice([lambda: _some(r, r.choice([32, 36, 40, 48, 64])), lambda: _some(r, 40, _ALNUM + "+/"), lambda: base64.b64encode(r.randbytes(r.choice([24, 32, 33, 48]))).decode()])(),
    "upper_hex": lambda r: _some(r, r.choice([32, 40, 64]), "0123456789ABCDEF"),
}
KINDS = (*BASE_KINDS, *FORMATS)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of base matches in code points, by start, then kind as listed."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)] + [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of all candidates, each once, by start inside each run."""
    out = []
    for m in CANDIDATE.finditer(text):
        run, start = m.group().strip("."), m.start() + len(m.group()) - len(m.group().lstrip("."))
        if len(run) >= SHORTEST:
            parts = {(0, len(run))} | {n.span() for part in WITHIN for n in part.finditer(run)}
            out += [(start + s, start + e) for s, e in sorted(parts)]
    return out


def _source_tokens() -> list[str]:
    found: dict[str, None] = {}
    for module in SOURCES:
        spec = importlib.util.find_spec(module)
        if spec and spec.origin and spec.origin.endswith(".py"):
            with open(spec.origin, encoding="utf-8") as f:
                text = f.read()
            found.update(dict.fromkeys(text[s:e] for s, e in candidates(text)))
    return list(found)


def ordinary_tokens(rng: random.Random, n: int) -> dict[str, list[str]]:
    """About n tokens that are no credentials, by class: those of source text, one half, and made ones."""
    ends = ["", "", "n", "r", "s", "t", "l", "nd", "st", "ng", "m"]
    words = [_some(rng, 1, "bcdghjklmnprstvwz") + rng.choice(["", "", "", "r", "l", "h"]) + _some(rng, 1, "aeeiiou") + rng.choice(ends) for _ in range(600)]
    word = lambda: "".join(rng.choices(words, k=rng.randrange(1, 4)))
    some = lambda low, high: [word() for _ in range(rng.randrange(low, high))]
    number = lambda k: str(rng.randrange(10 ** (k - 1), 10**k))
    made = {
        "id": lambda: str(uuid.UUID(int=rng.getrandbits(128))),
        "address": lambda: "www." + ".".join(some(1, 3)) + rng.choice([".com", ".org", ".de"]) + "/" + "/".join(some(1, 5)) + rng.choice(["", ".html", ".php", "/" + number(5)]),
        "path": lambda: "/".join(["", *some(2, 6)]) + rng.choice(["", ".py", ".parquet", ".tar.gz", "-" + number(3)]),
        "name": lambda: rng.choice("_-.").join(some(2, 6)) + rng.choice(["", number(2), "_v" + number(1)]),
        "camel": lambda: "".join(w.capitalize() for w in some(3, 7)),
        "shout": lambda: "_".join(w.upper() for w in some(2, 6)),
        "time": lambda: f"20{number(2)}-0{number(1)}-{number(2)}T{number(2)}.{number(2)}-{number(4)}{number(6)}",
        "number": lambda: number(rng.randrange(16, 30)),
        "rule": lambda: rng.choice("-=_./+") * rng.randrange(16, 80),
        "words": lambda: "".join(some(4, 9)),
        "slug": lambda: "-".join([word(), number(rng.randrange(2, 9)), word(), number(4)]),
        "version": lambda: ".".join(number(rng.randrange(1, 6)) for _ in range(rng.randrange(4, 8))),
    }
    read = _source_tokens()
    rng.shuffle(read)
    out = {"source": read[: n // 2]} if read else {}
    for kind, make in made.items():
        tokens = (make() for _ in range(n // 2 // len(made)))
        out[kind] = [t for t in tokens if len(t) >= SHORTEST]
    return out


class Tree:
    """A prefix tree, or what merging makes of it: per state the counts of its arcs, letter by letter, then of strings that end there, and where arcs lead (-1: nowhere)."""

    def __init__(self, strings: list[str]):
        arcs: list[dict[int, int]] = [{}]
        seen: list[tuple[int, int]] = []
        place = {c: i for i, c in enumerate(_ALPHABET)}
        for s in strings:
            at = 0
            for c in (place[c] for c in s):
                seen.append((at, c))
                if c not in arcs[at]:
                    arcs[at][c] = len(arcs)
                    arcs.append({})
                at = arcs[at][c]
            seen.append((at, len(_ALPHABET)))
        self.count = np.zeros((len(arcs), len(_ALPHABET) + 1), np.int32)
        np.add.at(self.count, tuple(np.array(seen, np.int64).reshape(-1, 2).T), 1)
        self.to = np.full((len(arcs), len(_ALPHABET)), -1, np.int32)
        for p, own in enumerate(arcs):
            for c, q in own.items():
                self.to[p, c] = q

    def near(self, states: np.ndarray, state: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Of states, those whose arcs Hoeffding's bound doesn't part from state's, the nearest first, and where each one's limit lies."""
        n, m = self.count[states].sum(1), self.count[state].sum()
        limit = bound * (1 / np.sqrt(n) + 1 / math.sqrt(m))
        apart = np.abs(self.count[states] / n[:, None] - self.count[state] / m)
        fine = np.flatnonzero(apart.max(1) <= limit)
        fine = fine[np.argsort(apart[fine].sum(1), kind="stable")]
        return states[fine], limit[fine]

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """Whether the bound parts neither the two states nor any two that equal strings lead to from them."""
        todo, done = [(a, b)], {(a, b)}
        while todo:
            p, q = todo.pop()
            fine, limit = self.near(np.array([p]), q, bound)
            if not len(fine):
                return False
            if limit[0] < 1:  # else nothing below can be parted
                for c in np.flatnonzero((self.to[p] >= 0) & (self.to[q] >= 0)):
                    pair = int(self.to[p, c]), int(self.to[q, c])
                    if pair[0] != pair[1] and pair not in done:
                        done.add(pair)
                        todo.append(pair)
        return True

    def fold(self, into: int, state: int) -> None:
        """Adds the subtree of state to into, as the automaton stays deterministic."""
        todo = [(into, state)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            for c in np.flatnonzero(self.to[b] >= 0):
                if self.to[a, c] < 0:
                    self.to[a, c] = self.to[b, c]
                else:
                    todo.append((int(self.to[a, c]), int(self.to[b, c])))


def inferred(strings: list[str], alpha: float = 0.05) -> Tree:
    """The automaton of strings: reached states, most often visited first, are merged with the nearest compatible one of those that stay, or stay."""
    tree, stay, bound = Tree(strings), [0], math.sqrt(0.5 * math.log(2 / alpha))
    while True:
        reached = np.setdiff1d(tree.to[stay], [-1, *stay])
        if not len(reached):
            return tree
        state = int(reached[np.argmax(tree.count[reached].sum(1))])
        home = next((p for p in tree.near(np.array(stay), state, bound)[0].tolist() if tree.compatible(p, state, bound)), None)
        if home is None:
            stay.append(state)
            continue
        rows, letters = np.nonzero(tree.to[stay] == state)
        tree.to[np.array(stay)[rows], letters] = home
        tree.fold(home, state)


@dataclass(frozen=True)
class Automata:
    """All automata as one table of states by bytes: follow and log_p, log_end; first holds their first states, those of formats, which have lengths and thresholds, and then those of ordinary classes."""

    follow: np.ndarray
    log_p: np.ndarray
    log_end: np.ndarray
    first: np.ndarray
    lengths: np.ndarray
    thresholds: np.ndarray

    def ratios(self, tokens: list[str]) -> np.ndarray:
        """For each token and format the log of its likelihood in the format less that in the likeliest ordinary class; -inf where the format has no such length."""
        length = np.array([len(t) for t in tokens], np.int64)
        out = np.full((len(tokens), len(self.lengths)), -np.inf)
        order = np.argsort(-length, kind="stable")
        order = order[length[order] <= self.lengths[:, 1].max()]
        if not len(order):
            return out
        data, size = np.frombuffer("".join(tokens[i] for i in order).encode("ascii"), np.uint8), length[order]
        begin = np.cumsum(size) - size
        state = np.tile(self.first, (len(order), 1))
        log = np.zeros(state.shape)
        for t in range(int(size[0])):
            n = int(np.searchsorted(-size, -t, "left"))  # those longer than t
            letter = data[begin[:n] + t][:, None]
            log[:n] += self.log_p[state[:n], letter]
            state[:n] = self.follow[state[:n], letter]
        log += self.log_end[state]
        fits = (size[:, None] >= self.lengths[:, 0]) & (size[:, None] <= self.lengths[:, 1])
        k = len(self.lengths)
        out[order] = np.where(fits, log[:, :k] - log[:, k:].max(1, keepdims=True), -np.inf)
        return out


def tables(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """follow, log_p, log_end and first of the automata, smoothed. An arc that was never seen leads to the automaton's own letter counts, for good."""
    codes, share = np.frombuffer(_ALPHABET.encode(), np.uint8), 1 / (len(_ALPHABET) + 1)
    out, base = [], 0
    for tree in trees:
        reached = [0]
        for s in reached:
            reached += [q for q in tree.to[s].tolist() if q >= 0 and q not in reached]
        place = np.full(len(tree.to) + 1, len(reached))  # the last one is for arcs that lead nowhere
        place[reached] = np.arange(len(reached))
        own = tree.count[reached]
        p = np.vstack([(own + share) / (own.sum(1, keepdims=True) + 1), (own.sum(0) + 1) / (own.sum() + own.shape[1])])
        follow, log_p = np.full((len(p), 256), base + len(reached)), np.full((len(p), 256), -np.inf)
        follow[:-1, codes], log_p[:, codes] = base + place[tree.to[reached]], np.log(p[:, :-1])
        out.append((follow, log_p, np.log(p[:, -1]), base))
        base += len(p)
    follow, log_p, log_end, first = zip(*out, strict=True)
    return np.vstack(follow).astype(np.int32), np.vstack(log_p), np.concatenate(log_end), np.array(first, np.int32)


def fit(credentials: dict[str, list[str]], ordinary: dict[str, list[str]], apart: list[str], false_share: float = FALSE_SHARE) -> Automata:
    """Automata of labelled credentials by format and of ordinary tokens by class; each format's threshold is set on ordinary tokens that were set apart.

    A format whose labelled credentials are of one length has that one, another those from 0.8 of the shortest to 1.5 of the longest.
    """
    least, most = (np.array([f(map(len, own)) for own in credentials.values()]) for f in (min, max))
    lengths = np.stack([np.where(least == most, least, least * 8 // 10), np.where(least == most, most, most * 15 // 10)], 1)
    found = tables([inferred(own) for own in [*credentials.values(), *ordinary.values()]])
    ratios = Automata(*found, lengths, np.zeros(len(lengths))).ratios(apart)
    reached = np.sort(ratios, 0)[::-1][int(false_share * len(apart))] if len(apart) else np.zeros(len(lengths))
    return Automata(*found, lengths, np.maximum(LEAST_RATIO, reached + 1e-9))


@functools.lru_cache(maxsize=1)
def fitted(labelled: int = LABELLED, ordinary: int = ORDINARY, seed: int = 23) -> Automata:
    """The automata of FORMATS, fitted on `labelled` examples of each and half of `ordinary` ordinary tokens; the other half sets the threshold."""
    rng = random.Random(seed)
    credentials = {name: [make(rng) for _ in range(labelled)] for name, make in FORMATS.items()}
    tokens = ordinary_tokens(rng, ordinary)
    return fit(credentials, {kind: own[::2] for kind, own in tokens.items()}, [t for own in tokens.values() for t in own[1::2]])


def scan(texts: list[str], automata: Automata, formats: tuple[str, ...]) -> list[list[tuple[str, int, int, float | None]]]:
    """(kind, start, end, score) of each text by start, then kind as listed: base spans, scores null, and candidates that touch none and reach the threshold, the likeliest of those that overlap."""
    base = [base_spans(t) for t in texts]
    tokens, place = [], []
    for i, text in enumerate(texts):
        starts = [s for _, s, _ in base[i]]
        ends = list(itertools.accumulate((e for _, _, e in base[i]), max))
        for s, e in candidates(text):
            before = bisect.bisect_left(starts, e)
            if not before or ends[before - 1] <= s:
                tokens.append(text[s:e])
                place.append((i, s, e))
    ratios = automata.ratios(tokens)
    best = (ratios - automata.thresholds).argmax(1)
    ratio = ratios[np.arange(len(best)), best]
    out: list[list[tuple]] = [[(*s, None) for s in own] for own in base]
    added: dict[int, list[tuple[float, int, int, str]]] = {}
    for k in np.flatnonzero(ratio >= automata.thresholds[best]).tolist():
        i, s, e = place[k]
        added.setdefault(i, []).append((-float(ratio[k]), s, e, formats[best[k]]))
    for i, own in added.items():
        chosen: list[tuple[int, int]] = []
        for score, s, e, kind in sorted(own):
            at = bisect.bisect_left(chosen, (s, e))
            if (not at or chosen[at - 1][1] <= s) and (at == len(chosen) or e <= chosen[at][0]):
                chosen.insert(at, (s, e))
                out[i].append((kind, s, e, -score))
    order = {k: n for n, k in enumerate((*BASE_KINDS, *formats))}
    return [sorted(own, key=lambda s: (s[1], order[s[0]])) for own in out]


def secret_scan(docs: DataFrame, text_col: str = "text", out_col: str = "secrets", automata: Automata | None = None, formats: tuple[str, ...] = tuple(FORMATS)) -> DataFrame:
    """docs with out_col, array<struct<kind, start, end, score>> of the secrets in a whole text, by start, then kind as listed.

    start and end are in code points, end exclusive. Base spans, kinds assign, access and hex, have a null score; a span
    that the automata add carries its log likelihood ratio. Null and empty texts have none; other columns, repeated rows
    and null ids pass through; a column named out_col is replaced. Texts may be of any length: a batch is scanned text by
    text. Automata of your own come from fit(), with their formats' names. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automata or fitted())  # a few hundred kilobytes, whatever the corpus

    def spans(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 256):
            out += scan([t or "" for t in texts[at : at + 256].to_pylist()], shared.value, formats)
        fields = [pa.field("kind", pa.string()), pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("score", pa.float64())]
        return pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in own] for own in out], pa.list_(pa.struct(fields)))

    spans.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    found = F.arrow_udf(spans, "array<struct<kind: string, start: int, end: int, score: double>>")
    return docs.withColumn(out_col, found(F.col(text_col)))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
