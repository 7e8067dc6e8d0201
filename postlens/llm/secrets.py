"""Secret scans by assignment-aware lexing.

The lexer reads source and configuration syntax (``name = "x"``, ``"name": "x"``, ``NAME=x``,
``name: x``, ``name := "x"``, ``name => 'x'``, ``name: type = "x"``, ``a = b = "x"``) into name-literal
pairs; literals may hold escapes, stand on a line of their own between triple quotes, or as the first
line of a block (``name: |``). Comments are read like code. Names that stand for a constant are followed to the literal, and ``"a" + B`` joins the parts. A literal scores by how
sensitive the names are that reach it and by how little it looks like a word or a placeholder;
those at or above the threshold are reported where they are written. Beside it run three fixed
patterns (assign, access, hex), whose spans always stay.

It is a map over whole texts without a shuffle. A vectorised look at the bytes of a slice picks
the documents that can hold anything; only those are lexed.

Spans are code points, end exclusive. Defined results: null or empty texts have no spans,
repeated documents get equal ones, an empty table gives no rows, very long texts are lexed whole, rows
without an id are scanned like others, and other columns pass through under their names but one called
``secret_spans``, which the result replaces.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import textkit as tk
from postlens.llm.shared import lean, small_batches

# The base patterns, their least lengths and their order.
KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

#: Parts of names, and how sensitive a name with that part is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0,
    "privatekey": 1.0, "accesskey": 1.0, "credential": 1.0, "auth": 0.6, "signing": 0.7, "encryption": 0.7, "key": 0.5,
}
#: Words that hold a part by chance.
ORDINARY = re.compile("author(?!i[sz])|tokeni[sz]|keyword|keyboard|monkey|donkey|turkey|hockey|(sort|primary|foreign|partition|cache)key")
#: Words that make a value a stand-in.
PLACEHOLDER = re.compile(r"(?i)example|changeme|placeholder|your[_-]|xxxx|\.\.\.|<|\$\{|%\(|dummy|redacted")
THRESHOLD = 0.9
LEAST_LITERAL = 8
#: Brackets of a type are at most so long.
MOST_TYPE = 80
#: Characters of a value's ends in which a stand-in may begin or end (one less than the longest), and a sum of counts beyond which they are scaled.
_ENDS, _MANY = 10, 2.0**60

_FRAGMENTS = tuple(f.encode() for f in ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "auth", "signing", "encryption"))
_ASSIGN_FRAGMENTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_SEPARATORS = tk.byte_class((45, 46), (95, 95))
_HEX_BYTES = tk.byte_class((48, 57), (97, 102))
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
#: A literal: in triple quotes, in quotes (with escapes), the first line of a block, or bare.
_PART = (
    r'''(?P<v{n}>"""[ \t]*+\n?[ \t]*+(?P<t{n}>[^"\n]++)\n?[ \t]*+"""|"(?P<d{n}>(?:[^"\\\n]|\\.)*+)"|'''
    r"""'(?P<s{n}>(?:[^'\\\n]|\\.)*+)'|[|>][+-]?[ \t]*+\n[ \t]++(?P<y{n}>\S++)|(?P<b{n}>[A-Za-z0-9+/_.=\-]++))"""
)
_ATOM = rf"[A-Za-z_][A-Za-z0-9_.]*+(?:\[[^\]\n=]{{0,{MOST_TYPE}}}+\]|<[^>\n=]{{0,{MOST_TYPE}}}+>)*+\??"
_TYPE = rf"""[&*]*+(?:'[a-z]++[ ])?(?:(?:const|mut|readonly)[ ])?(?P<type>{_ATOM}(?:[ ]?\|[ ]?{_ATOM})*+)"""
_PAIR = re.compile(rf"""(?<![A-Za-z0-9_.\-])(?P<q>["']?)(?P<name>{_NAME})(?P=q)[ \t]*+(?:[?!]?:[ \t]*+{_TYPE}(?:[ \t]++=(?![=>])|=(?=[ \t]*+["']))|:=|=>|=(?!=)|:(?!/))[ \t]*+""" + _PART.format(n=0))
#: A further name of a chained assignment, where a literal could stand.
_CHAIN = re.compile(rf"""(?P<name>{_NAME})(?:[ \t]++=(?![=>])|=(?=[ \t]*+["']))[ \t]*+(?={_PART.format(n=2)})""")
_VALUE = re.compile(_PART.format(n=0))
_JOIN = re.compile(r"[ \t]*+\+[ \t]*+" + _PART.format(n=1))


def _sensitivity(name: str) -> float:
    flat = ORDINARY.sub(" ", re.sub(r"[_.\-]", "", name).lower())
    return max((v for k, v in SENSITIVE.items() if k in flat), default=0.0)


class _Value:
    """What a literal or joined literals say, without the joined text: constants may double (``b = a + a``), so parts are shared.

    ``parts`` are the values that it joins; a literal has none, but a span. ``counts`` tells how often each character occurs, divided by 2 to
    the ``scale``: exact up to ``_MANY`` characters.
    """

    __slots__ = ("span", "parts", "score", "text", "counts", "scale", "head", "tail", "stand_in")

    def __init__(self, text: str, span: tuple[int, int] | None = None, parts: tuple[_Value, ...] = ()) -> None:
        self.span, self.parts, self.score, self.text, self.counts, self.scale = span, parts, 0.0, text, None, 0
        self.head, self.tail = text[:_ENDS], text[-_ENDS:]
        self.stand_in = False

    def told(self) -> _Value:
        """With the literal's characters counted."""
        if self.counts is None:
            self.counts, self.stand_in = Counter(self.text), bool(PLACEHOLDER.search(self.text))
        return self

    @property
    def size(self) -> float:
        return sum(self.counts.values())


def _joined(parts: list[_Value]) -> _Value:
    """One value of several: counts are added up, and a stand-in across a seam is looked for in the ends."""
    if len(parts) == 1:
        return parts[0]
    out = _Value("", None, tuple(parts))
    out.counts = Counter()
    out.scale = max(p.told().scale for p in parts)
    seam = ""
    for p in parts:
        factor = 2 ** (out.scale - p.scale) if out.scale - p.scale < 1000 else math.inf
        for c, n in p.counts.items():
            out.counts[c] += n if factor == 1 else n / factor
        out.stand_in |= p.stand_in or bool(PLACEHOLDER.search(seam + p.head))
        # A value of fewer characters than its ends may be has all of them in both.
        seam = p.tail if len(p.tail) == _ENDS else (seam + p.tail)[-_ENDS:]
        out.head = (out.head + p.head)[:_ENDS] if len(out.head) < _ENDS else out.head
    out.tail = seam
    if (size := out.size) > _MANY:
        more = math.frexp(size)[1]
        out.scale += more
        out.counts = Counter({c: math.ldexp(n, -more) for c, n in out.counts.items()})
    return out


def _entropy(v: _Value) -> float:
    size = v.size
    return -sum(c / size * math.log2(c / size) for c in v.counts.values() if c)


def _random(v: _Value) -> bool:
    """Whether a literal looks random enough for a name that says little."""
    return (v.told().scale > 0 or v.size >= 12) and _strength(v) == 1.0 and _entropy(v) >= 3.2 and bool(re.search("[0-9]", seen := "".join(v.counts))) and bool(re.search("[A-Za-z]", seen))


def _score(name: str, v: _Value) -> float:
    weight = _sensitivity(name)
    return max(weight * _strength(v), THRESHOLD if _random(v) else 0.0) if weight else 0.0


def _strength(v: _Value) -> float:
    """0 to 1: entropy of the literal, less for words and stand-ins."""
    if (v.told().scale == 0 and v.size < LEAST_LITERAL) or v.stand_in or " " in v.counts:
        return 0.0
    seen = "".join(v.counts)
    kinds = sum(bool(re.search(p, seen)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, _entropy(v) / 3.0) * (1.0 if kinds >= 2 else 0.6)


def lex(text: str) -> list[tuple[int, int, float]]:
    """Literals that reach a sensitive name: start, end, score."""
    constants: dict[str, _Value | None] = {}
    scored: list[_Value] = []  # literals and what joins them, parts first

    def literal(span: tuple[int, int], value: str) -> _Value:
        scored.append(_Value(value, span))
        return scored[-1]

    def part(m: re.Match, n: int, own: list[str]) -> list[_Value]:
        for kind in "tdsy":
            if m[f"{kind}{n}"] is not None:
                return [literal(m.span(f"{kind}{n}"), m[f"{kind}{n}"])]
        bare = m[f"b{n}"]
        if text[m.end() : m.end() + 1] in ("[", "("):  # an index or a call
            return []
        known = None if bare in own else constants.get(bare)
        return [known or literal(m.span(f"b{n}"), bare)]

    at = 0
    while m := _PAIR.search(text, at):
        names, at, unsure = [m["name"]], m.start("v0"), []
        if m["type"] is not None:
            unsure.append((m.span("type"), m["type"]))
        while j := _CHAIN.match(text, at):
            unsure.append((j.span("name"), j["name"]))
            names.append(j["name"])
            at = j.end()
        m = _VALUE.match(text, at)
        parts, at = part(m, 0, names), m.end()
        while j := _JOIN.match(text, at):
            parts += part(j, 1, names)
            at = j.end()
        value = _joined(parts) if parts else None
        if len(parts) > 1:
            scored.append(value)
        for name in names:
            constants[name] = value
        # What stands as a type or a further name could be a literal itself.
        sensitive = any(map(_sensitivity, names))
        others = [v for span, u in unsure if sensitive and "." not in u and _random(v := literal(span, u))]
        for found in ([value] if value and sensitive else []) + others:
            found.score = max(found.score, *(_score(name, found) for name in names))
    best: dict[tuple[int, int], float] = {}
    for v in reversed(scored):  # what joins a value hands its score on before the value does
        if v.score > 0 and v.span:
            best[v.span] = max(v.score, best.get(v.span, 0.0))
        for p in v.parts:
            p.score = max(p.score, v.score)
    return sorted((a, z, v) for (a, z), v in best.items())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, end and kind of the fixed patterns' spans."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def all_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Base spans, and the lexer's that no base span holds."""
    base = base_spans(text)
    more = [(a, z, 3) for a, z, v in lex(text) if v >= threshold and not any(x <= a and z <= y for x, y, _ in base)]
    return sorted(base + more, key=lambda x: (x[0], x[2], x[1]))


def _rows_with(offs: np.ndarray, raw: bytes, fragments: tuple[bytes, ...]) -> set[int]:
    """Rows, which begin at ``offs``, that hold one of the fragments."""
    found: set[int] = set()
    for f in fragments:
        at = raw.find(f)
        while at >= 0:
            r = int(np.searchsorted(offs, at, "right")) - 1
            if at + len(f) <= offs[r + 1]:
                found.add(r)
                at = raw.find(f, int(offs[r + 1]))
            else:
                at = raw.find(f, at + 1)
    return found


def candidates(s: tk.Slice) -> set[int]:
    """Rows that may hold a span: a superset, found without looking at rows one by one."""
    start, end, _ = tk.runs(_HEX_BYTES[s.buf], s.offs)
    hot = start[end - start >= HEX_LEAST]
    rows = set((np.searchsorted(s.offs, hot, "right") - 1).tolist())
    # Names count without their separators, so their parts are looked for in the bytes without them.
    lowered = tk.lower(s.buf)
    kept = ~_SEPARATORS[s.buf]
    offs = np.concatenate([[0], np.cumsum(kept)])[s.offs]
    rows |= _rows_with(offs, lowered[kept].tobytes(), _FRAGMENTS)
    return rows | _rows_with(s.offs, s.buf.tobytes(), (b"AKIA",)) | _rows_with(s.offs, lowered.tobytes(), _ASSIGN_FRAGMENTS)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``secret_spans`` (array of start, end, kind number, flat; by start, then kind) to ``docs``; it replaces a column of that name."""
    small_batches(docs.sparkSession)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))

    def run(batches):
        for b in batches:
            spans: list[list[int]] = [[] for _ in range(b.num_rows)]
            for s in tk.slices(b.column(text)):
                for r in candidates(s):
                    spans[s.first + r] = [v for span in all_spans(s.raw(r).decode(), threshold) for v in span]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(spans, pa.list_(pa.int32()))], [*names, "_spans"])

    out = docs.toDF(*names).mapInArrow(lean(run), f"{fields}, _spans array<int>")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, docs.columns) if k != "secret_spans"], F.col("_spans").alias("secret_spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``; ``n_chars`` follows. Clean rows stay as they are."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    fields = ", ".join(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def run(batches):
        for b in batches:
            cols = [b.column(i) for i in range(len(names))]
            changed: dict[int, str] = {}
            for s in tk.slices(cols[at]):
                for r in candidates(s):
                    text = s.raw(r).decode()
                    out, last = [], 0
                    for x, y, _ in all_spans(text, threshold):
                        if y > last:
                            if x >= last:
                                out += [text[last:x], mark]
                            last = y
                    if out:
                        changed[s.first + r] = "".join(out) + text[last:]
            if changed:
                texts = cols[at].to_pylist()
                for i, t in changed.items():
                    texts[i] = t
                cols[at] = pa.array(texts, cols[at].type)
                if size is not None:
                    sizes = cols[size].to_pylist()
                    for i, t in changed.items():
                        sizes[i] = len(t)
                    cols[size] = pa.array(sizes, cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, [f"_c{i}" for i in range(len(names))])

    return docs.toDF(*[f"_c{i}" for i in range(len(names))]).mapInArrow(lean(run), fields).toDF(*names)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, z, k in spans)


def base_digest(text: str) -> str:
    return hashlib.sha256(joined(base_spans(text)).encode()).hexdigest()


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    each = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("secret_spans") / 3).cast("int") - 1),
        lambda i: F.struct(*[F.element_at("secret_spans", i * 3 + k + 1).alias(n) for k, n in enumerate(("a", "z", "kind"))]),
    )
    found = scan(docs).select("doc_id", F.when(F.size("secret_spans") > 0, each).otherwise(F.array().cast("array<struct<a:int,z:int,kind:int>>")).alias("s"))
    kind = F.array(*map(F.lit, KINDS))
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(kind, x.kind + 1), x.a, x.z)), ",")
    count = lambda k: F.size(F.filter("s", lambda x: x.kind == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(told(F.filter("s", lambda x: x.kind < 3)).cast("binary"), 256).alias("base_sha256"), told(F.col("s")).alias("spans"),
    )
