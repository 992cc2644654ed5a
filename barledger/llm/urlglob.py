"""URL rules in one multiword Shift-And automaton, run over batches of canonical URLs."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: (verdict, host, path): fits the host and its subdomains if the path begins with ``path``; the longest wins.
HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Globs over host and path, for URLs without a host rule: ``*`` any run without ``/``, ``**`` any run, ``?`` one byte but ``/``.
BLOCK_GLOBS = ("*spam-farm.**", "*cheap-pills.**", "**/cgi-bin/**", "**/wp-login.php", "**.exe", "**.zip", "ads.*/**", "*.ads.*/**")
ALLOW_GLOBS = ("www.*.edu/**", "*.gov/**")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SLASH = ord("/")

#: One step of a pattern: a byte to match, or ANY for one byte but a slash, RUN and DEEP for runs without and with slashes.
ANY, RUN, DEEP = -1, -2, -3


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def glob_steps(glob: str) -> list[int]:
    steps, data, i = [], glob.encode(), 0
    while i < len(data):
        if data[i:i + 2] == b"**":
            steps.append(DEEP)
            i += 2
            continue
        steps.append({ord("*"): RUN, ord("?"): ANY}.get(data[i], data[i]))
        i += 1
    return steps


def host_rule_steps(rule_host: str, rule_path: str) -> list[list[int]]:
    """The host itself and its subdomains, with the path's beginning."""
    literal = [*(rule_host + rule_path).encode(), DEEP]
    return [literal, [RUN, ord("."), *literal]]


class Automaton:
    """All patterns side by side: one bit per pattern position, one mask row per byte.

    A step is ``((state << 1) & accept[byte]) | (state & loop[byte])``; the shift carries from word to
    word, and the first bit of a pattern accepts no byte, so that nothing runs over from its neighbour.
    """

    def __init__(self, patterns: list[list[int]]):
        bits = sum(1 + sum(s > RUN for s in p) for p in patterns)
        self.words = max(1, -(-bits // 64))
        accept = np.zeros((256, self.words * 64), dtype=bool)
        loop = np.zeros((256, self.words * 64), dtype=bool)
        start = np.zeros(self.words * 64, dtype=bool)
        self.final, at = [], 0
        for p in patterns:
            start[at] = True
            for s in p:
                if s == DEEP:
                    loop[:, at] = True
                elif s == RUN:
                    loop[np.arange(256) != _SLASH, at] = True
                else:
                    at += 1
                    accept[np.arange(256) != _SLASH if s == ANY else s, at] = True
            self.final.append(at)
            at += 1
        self.accept, self.loop, self.start = (self._packed(x) for x in (accept, loop, start))

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=-1, bitorder="little").view("<u8")

    def match(self, urls: list[bytes]) -> np.ndarray:
        """urls x patterns: which pattern fits the whole of which URL."""
        order = np.argsort([-len(u) for u in urls], kind="stable")
        lengths = np.array([len(urls[i]) for i in order], dtype=np.int64)
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(urls[i] for i in order), dtype=np.uint8)
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        for t in range(int(lengths[0]) if len(urls) else 0):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # URLs longer than t
            byte = data[ends[:n] - lengths[:n] + t]
            s = state[:n]
            shifted = s << np.uint64(1)
            shifted[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:n] = (shifted & self.accept[byte]) | (s & self.loop[byte])
        hits = np.zeros((len(urls), len(self.final)), dtype=bool)
        for k, bit in enumerate(self.final):
            hits[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return hits


def judge(pages: DataFrame, url_col: str = "url", host_rules=HOST_RULES, block_globs=BLOCK_GLOBS, allow_globs=ALLOW_GLOBS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` of each row's URL.

    The longest host rule that fits decides; without one, an allow glob, then a block glob, then allow.
    A null URL or one without ``://`` has empty host and path, fits no host rule and is judged by the
    globs like any other. Columns of these names are replaced; rows are judged one by one, whole:
    repeated rows get equal verdicts, and an empty table stays empty.
    """
    patterns, owners = [], []
    for i, (_, rule_host, rule_path) in enumerate(host_rules):
        for steps in host_rule_steps(rule_host, rule_path):
            patterns.append(steps)
            owners.append(i)
    rules_end = len(patterns)
    patterns += [glob_steps(g) for g in (*allow_globs, *block_globs)]
    allow_end = rules_end + len(allow_globs)
    rank = sorted(range(len(host_rules)), key=lambda i: (-len(host_rules[i][1] + host_rules[i][2]), i))
    automaton = Automaton(patterns)

    def decide(keys: pd.Series) -> pd.DataFrame:
        hits = automaton.match([k.encode() for k in keys])
        rule = np.full(len(keys), -1)
        for i in reversed(rank):
            rule[hits[:, [p for p, o in enumerate(owners) if o == i]].any(axis=1)] = i
        allowed, blocked = hits[:, rules_end:allow_end].any(axis=1), hits[:, allow_end:].any(axis=1)
        verdict = np.where(blocked & ~allowed, "block", "allow").astype(object)
        names = np.full(len(keys), None, dtype=object)
        for i, (what, rule_host, rule_path) in enumerate(host_rules):
            verdict[rule == i] = what
            names[rule == i] = rule_host + rule_path
        return pd.DataFrame({"rule": pd.Series(names, dtype="object"), "verdict": pd.Series(verdict, dtype="object")})

    added = ("host", "path", "rule", "verdict")
    names = [F.col(c) for c in pages.columns if c.lower() not in added]
    url = F.col(url_col).cast("string")
    found = F.pandas_udf(decide, "rule string, verdict string")(F.concat("host", "path"))
    split = pages.select(F.struct(*names).alias("row"), host(url).alias("host"), path(url).alias("path"))
    return split.withColumn("judged", found).select("row.*", "host", "path", "judged.*")
