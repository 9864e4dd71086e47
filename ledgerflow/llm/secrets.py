"""Secret scans behind a trigram inverted index.

From each rule's pattern a Boolean trigram query is derived: clauses that must all
hold, each a choice between sets of trigrams. A segment of documents gets postings
for the trigrams that the rules ask for; a query intersects and unites them, and only
the remaining documents are searched with the pattern. A rule without mandatory
trigrams searches every document of the segment.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import give_back, map_slices, sliced

#: Strings that a part of a pattern may stand for and still be listed.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A match counts if its group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        pattern = self.pattern
        if self.least > 1 and not self.group and re.fullmatch(r"\[[^\]\\]+\]\+", pattern):
            # One repeated class: its longest runs are the matches, so ask for the length at once.
            pattern = f"{pattern[:-1]}{{{self.least},}}"
        return re.compile(pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The kinds that every scan reports.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further well-known forms of credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?"),
)
RULES = BASE_RULES + MORE_RULES

Clause = frozenset[frozenset[str]]


def _strings(node) -> set[str] | None:
    """The strings that a parsed item stands for, or None if they are many or unbounded."""
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return {chr(value)}
    if kind == "IN":
        found: set[str] = set()
        for part, inner in value:
            if str(part) == "LITERAL":
                found.add(chr(inner))
            elif str(part) == "RANGE" and inner[1] - inner[0] < 8:
                found |= {chr(c) for c in range(inner[0], inner[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if kind == "SUBPATTERN":
        return _sequence(value[-1])
    if kind == "BRANCH":
        parts = [_sequence(option) for option in value[1]]
        return None if None in parts else set().union(*parts)
    if kind in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = value
        one = _sequence(inner) if int(high) <= 2 else None
        return None if one is None else set().union(*(_product([one] * n) for n in range(low, int(high) + 1)))
    return {""} if kind == "AT" else None


def _product(parts: list[set[str]]) -> set[str]:
    return {"".join(choice) for choice in itertools.product(*parts)}


def _sequence(nodes) -> set[str] | None:
    strings = {""}
    for node in nodes:
        part = _strings(node)
        if part is None or len(strings) * len(part) > MOST_STRINGS:
            return None
        strings = _product([strings, part])
    return strings


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses over lower-case trigrams that every match of the pattern fulfils."""
    from re import _parser

    return _clauses(_parser.parse(pattern))


def _clauses(nodes) -> list[Clause]:
    clauses: list[Clause] = []
    run = {""}

    def flush() -> None:
        choices = {frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in run}
        if run and all(choices):
            # A choice that asks for more than another adds nothing.
            clauses.append(frozenset(c for c in choices if not any(other < c for other in choices)))

    for node in nodes:
        part = _strings(node)
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = _product([run, part])
            continue
        flush()
        kind, value = str(node[0]), node[1]
        if part is not None:
            run = part
            continue
        run = {""}
        if kind == "SUBPATTERN":
            clauses += _clauses(value[-1])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            clauses += _clauses(value[2])
    flush()
    return clauses


class Segment:
    """Postings of a batch of texts, made per trigram when a query first asks for it."""

    def __init__(self, texts: pa.Array):
        self._lowered = pc.ascii_lower(texts)
        self._all = np.arange(len(texts))
        self._postings: dict[str, np.ndarray] = {}

    def posting(self, trigram: str) -> np.ndarray:
        if trigram not in self._postings:
            has = pc.match_substring(self._lowered, trigram).to_numpy(zero_copy_only=False)
            self._postings[trigram] = np.flatnonzero(has)
        return self._postings[trigram]

    def candidates(self, query: list[Clause]) -> np.ndarray:
        rows = self._all
        for clause in query:
            some = np.empty(0, rows.dtype)
            for trigrams in clause:
                every = rows
                for trigram in sorted(trigrams):
                    if not len(every):
                        break
                    every = np.intersect1d(every, self.posting(trigram), assume_unique=True)
                some = np.union1d(some, every)
            rows = some
        return rows


def _span_type() -> pa.DataType:
    return pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) per row of `docs`.

    Spans are ordered by start, then by the rules' order. Matches of one kind don't
    overlap; those of several kinds may. Null and empty texts have no spans, repeated
    rows are searched each, a null doc_id stays null, other columns are left out.
    """

    def work():
        compiled = [(rule, rule.compiled(), trigram_query(rule.pattern)) for rule in rules]

        def batch(part: pa.RecordBatch) -> dict:
            texts = pc.fill_null(part.column("text"), "")
            segment = Segment(texts)
            spans: list[list] = [[] for _ in range(len(texts))]
            whole: dict[int, str] = {}
            for place, (rule, pattern, query) in enumerate(compiled):
                for i in segment.candidates(query).tolist():
                    text = whole.get(i)
                    if text is None:
                        text = whole[i] = texts[i].as_py()
                    for match in pattern.finditer(text):
                        if match.end(rule.group) - match.start(rule.group) >= rule.least:
                            spans[i].append((match.start(), place, match.end(), rule.kind))
            out = [[{"kind": k, "start": s, "end": e} for s, _, e, k in sorted(found)] for found in spans]
            return {"doc_id": part.column("doc_id"), "spans": pa.array(out, _span_type())}

        return batch

    columns = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return map_slices(columns, work, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and both joined forms of `find_secrets`' rows."""
    kinds = [rule.kind for rule in BASE_RULES]
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = f"filter(spans, s -> s.kind in ({', '.join(map(repr, kinds))}))"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in kinds),
        F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """`docs` with each run of overlapping spans replaced by `mark` and n_chars kept true.

    Rows without spans come back as they are, null and empty texts too.
    """
    schema = docs.schema

    def run(batches):
        compiled = [(rule, rule.compiled(), trigram_query(rule.pattern)) for rule in rules]
        for part in sliced(batches):
            texts = pc.fill_null(part.column("text").cast(pa.string()), "")
            segment = Segment(texts)
            spans: dict[int, list] = {}
            for rule, pattern, query in compiled:
                for i in segment.candidates(query).tolist():
                    for match in pattern.finditer(texts[i].as_py()):
                        if match.end(rule.group) - match.start(rule.group) >= rule.least:
                            spans.setdefault(i, []).append(match.span())
            if not spans:
                yield part
                continue
            new = part.column("text").to_pylist()
            for i, found in spans.items():
                kept, at = [], 0
                for start, end in merged(found):
                    kept += [new[i][at:start], mark]
                    at = end
                new[i] = "".join([*kept, new[i][at:]])
            columns = {name: part.column(name) for name in part.schema.names}
            columns["text"] = pa.array(new, part.column("text").type)
            if "n_chars" in columns:
                sizes = columns["n_chars"].to_pylist()
                for i in spans:
                    sizes[i] = len(new[i])
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=part.schema)
        give_back()

    return docs.mapInArrow(run, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each row."""
    return digest(find_secrets(docs))


def text_digest(spans: list[tuple[str, int, int]]) -> str:
    """The digest of plain tuples, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
