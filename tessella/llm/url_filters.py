"""URL rules and wildcard patterns in one bit-parallel automaton.

All patterns (`*` for any characters, `?` for one byte, the rest literal, the whole string must match) are packed into the bits
of a few 64-bit words, one bit for each literal position. A byte of the URL moves every pattern at once: shift, keep the bits
whose position takes this byte, add the bits that stay because a `*` follows them (Shift-And). URLs run in step, longest first, so
a task does a few numpy operations for each position of its longest URL and drops URLs that have ended; as many run at once as
keep the state at `STATE` words, whatever the number of patterns. Patterns and rules may come from a table, `MOST` at most.

The string that is matched is the canonical URL host#path. Neither host nor path can hold `#`, so a rule's host part cannot
match inside a path. A rule (host, path) is two patterns, for its host and for its subdomains.

A URL's host stands after the first "://" up to "/", "?", "#" or the end, with A-Z in lower case; its path goes on up to "?",
"#" or the end. Nulls and edges: a null URL, or one without "://", has an empty host and path, fits no rule and is allowed.
Every row gives one row; repeated rows give equal results. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path). The longest that fits decides.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Patterns over host#path that block a URL which no rule decides.
BLOCKED = (
    "*adult-*#*", "*casino*#*", "*cheap-pills*#*", "*free-bets*#*", "*spam-farm*#*", "*ads-track*#*",
    "ads.*#*", "adserver.*#*", "*.doubleclick.*#*", "*#*/wp-login.php", "*#*.exe",
)
#: 64-bit words of state of the URLs that run at once; and patterns that a table may have.
STATE, MOST = 1 << 21, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton:
    """Patterns packed into `words` 64-bit words; match() gives for each string which patterns match it whole."""

    def __init__(self, patterns: list[str]):
        bits: list[tuple[int, bool, bool]] = []  # for each literal: its byte or -1, a `*` right before, a `*` right after
        self.last: list[int] = []  # for each pattern: its last bit, or -1 where it has no literal
        self.open: list[bool] = []  # whether it ends with `*`
        first: list[int] = []
        for pattern in patterns:
            literals = [b for b in pattern.encode() if b != ord("*")]
            parts = pattern.encode().split(b"*")
            start, i = len(bits), 0
            for n, part in enumerate(parts):
                for k, b in enumerate(part):
                    i += 1
                    bits.append((-1 if b == ord("?") else b, n > 0 and k == 0, k == len(part) - 1 and n < len(parts) - 1))
            first.append(start if literals else -1)
            self.last.append(len(bits) - 1 if literals else -1)
            self.open.append(pattern.endswith("*"))
        self.words = max(1, -(-len(bits) // 64))
        self.take = np.zeros((256, self.words), dtype=np.uint64)  # bits that take a byte
        self.stay = np.zeros(self.words, dtype=np.uint64)  # bits that stay set: a `*` follows
        self.begin = np.zeros(self.words, dtype=np.uint64)  # first bits, which start at the first byte
        self.again = np.zeros(self.words, dtype=np.uint64)  # first bits after a leading `*`, which start anywhere
        self.heads = np.zeros(self.words, dtype=np.uint64)
        put = lambda mask, i: mask.__setitem__(i // 64, mask[i // 64] | np.uint64(1 << (i % 64)))
        for i, (byte, _, after) in enumerate(bits):
            for b in range(256) if byte < 0 else [byte]:
                put(self.take[b], i)
            if after:
                put(self.stay, i)
        for i in first:
            if i >= 0:
                put(self.heads, i)
                put(self.again if bits[i][1] else self.begin, i)

    def match(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(strings, patterns) booleans for the strings data[start : start + length] of bytes."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state = np.zeros((len(order), self.words), dtype=np.uint64)
        longest = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
        top = np.uint64(63)
        for t in range(longest):
            now = state[: active[t]]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= ~self.heads
            moved |= self.again
            if t == 0:
                moved |= self.begin
            # a bit that stays because of `*` also starts its successor later: it remains set
            state[: active[t]] = (moved & self.take[data[starts[: active[t]] + t]]) | (now & self.stay)
        out = np.zeros((len(order), len(self.last)), dtype=bool)
        for p, i in enumerate(self.last):
            if i < 0:
                out[:, p] = self.open[p] | (lengths == 0)
            else:
                out[:, p] = (state[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) != 0
        result = np.empty_like(out)
        result[order] = out
        return result


def host_and_path(url):
    """Spark columns (host, path) of a URL column."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.substr(url, F.instr(url, "://") + 3), F.lit("#")), "#", 1)), F.lit(""))
    rest = F.substring_index(rest, "?", 1)
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substr(rest, F.length(host) + 1)


def listed(patterns: DataFrame) -> list[tuple[str, ...]]:
    """The rows of a table of rules (verdict, host and path) or of patterns, in the order of its columns; ValueError beyond `MOST`."""
    rows = patterns.distinct().orderBy(*patterns.columns).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} patterns")
    return [tuple(r) for r in rows]


def judge(pages: DataFrame, rules=RULES, blocked=BLOCKED) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern for every row; `pattern` is the first blocking pattern where no rule fits."""
    patterns, texts = [], [text for _, text in rules]
    for text in texts:
        host, _, path = text.partition("/")
        patterns += [f"{host}#/{path}*", f"*.{host}#/{path}*"]
    automaton = Automaton(patterns + list(blocked))
    by_length = sorted(range(len(rules)), key=lambda i: len(texts[i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path = batch.column("host").cast(pa.string()), batch.column("path").cast(pa.string())
            joined = pc.binary_join_element_wise(host, path, "#").cast(pa.binary())
            _, offsets, data = joined.buffers()
            offsets = np.frombuffer(offsets, dtype=np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
            data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
            size = max(1, STATE // automaton.words)
            parts = [slice(a, a + size) for a in range(0, len(joined), size)]
            hit = np.concatenate([automaton.match(data, offsets[:-1][p], np.diff(offsets)[p]) for p in parts] or [np.zeros((0, len(automaton.last)), dtype=bool)])
            rule = np.full(len(joined), -1)
            for i in by_length:
                rule[hit[:, 2 * i] | hit[:, 2 * i + 1]] = i
            more = hit[:, 2 * len(rules) :]
            first = np.where(more.any(axis=1) & (rule < 0), more.argmax(axis=1) if more.shape[1] else 0, -1)
            rule_text = [texts[i] if i >= 0 else None for i in rule.tolist()]
            verdict = [rules[i][0] if i >= 0 else "block" if j >= 0 else "allow" for i, j in zip(rule.tolist(), first.tolist())]
            pattern = [blocked[j] if j >= 0 else None for j in first.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), host, path, pa.array(rule_text, pa.string()), pa.array(verdict, pa.string()), pa.array(pattern, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict", "pattern"],
            )

    host, path = host_and_path(F.col("url"))
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")
