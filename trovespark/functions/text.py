"""Scalar functions over paths, citations, identifiers and bodies, as column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

#: Enumerations of the evidence contract.
INTENTS = ("", "bug_fix", "feature_add", "refactor", "arch_explain", "test_add", "concurrency_safety", "security", "docs_update", "qa_review")
RELATIONS = ("calls", "called_by", "implements", "imports", "references", "tested_by", "embeds", "defines")
REDACTIONS = ("mask", "drop", "fail_closed")

#: Fixed value: the path glob of tests.
TEST_GLOB = "*_test.go"
SNIPPET_MARK = "\n… [truncated]"


def citation_valid(file: Column, start: Column, end: Column) -> Column:
    return F.coalesce((file != "") & (start > 0) & (end > 0) & (start <= end), F.lit(False))


def citation_key(file: Column, start: Column, end: Column) -> Column:
    """Identity of a citation; the commit is no part of it."""
    return F.format_string("%s:%d-%d", file, start, end)


def citation_string(file: Column, start: Column, end: Column, commit: Column) -> Column:
    """file, file:line or file:start-end, with @commit where there is one."""
    at = F.when((start <= 0) | start.isNull(), file).when(start == end, F.concat(file, F.lit(":"), start.cast("string"))).otherwise(citation_key(file, start, end))
    return F.when(F.coalesce(commit, F.lit("")) == "", at).otherwise(F.concat(at, F.lit("@"), commit))


def is_test_path(path: Column) -> Column:
    """Test files by suffix, prefix or directory conventions of Go, TypeScript, JavaScript and Solidity."""
    base = F.regexp_extract(path, "[^/]*$", 0)
    named = base.rlike(r"(_test\.go|\.(test|spec)\.[jt]sx?|\.t\.sol)$") | base.rlike(r"^test_")
    return named | path.rlike(r"(^|/)(test|tests|testdata|__tests__)/")


def glob_regex(glob: str) -> str:
    """A path glob as an anchored pattern; * and ? stay within one segment."""
    special = {"*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(special.get(c, "\\" + c if c in ".^$+{}()|\\" else c) for c in glob) + "$"


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded down."""
    return F.floor(F.char_length(text) / 4).cast("int")


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from 1 and inclusive; the end is clamped; empty if the range is."""
    lines = F.split(text, "\n")
    last = F.least(end, F.size(lines))
    return F.when((start >= 1) & (start <= last), F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(last - start + 1, F.lit(0))), "\n")).otherwise(F.lit(""))


def head_snippet(text: Column, lines: int = 8) -> Column:
    """The first lines and a mark; empty if the text has no more than those."""
    parts = F.split(text, "\n")
    return F.when(F.size(parts) > lines, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit(SNIPPET_MARK))).otherwise(F.lit(""))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for empty vectors, different lengths or a zero norm."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), total(a, b) / norm).otherwise(F.lit(0.0))


def identifiers(text: Column) -> Column:
    """Words that may be identifiers, of three characters or more, in order."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_]{2,}"), F.lit(0))


def pascal(a: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(a, 1, 1)), F.substring(a, 2, 1 << 20))


def camel(a: Column) -> Column:
    return F.concat(F.lower(F.substring(a, 1, 1)), F.substring(a, 2, 1 << 20))


def compounds(words: Column, most: int = 10) -> Column:
    """Pascal and camel joins of adjacent pairs and triples of the first words; per position pair Pascal, pair camel, triple Pascal, triple camel."""
    w = F.slice(words, 1, most)

    def at(i: Column) -> Column:
        a, b, c = (F.try_element_at(w, (i + k).cast("int")) for k in range(3))
        pair, triple = F.concat(pascal(b)), F.concat(pascal(b), pascal(c))
        return F.filter(F.array(F.concat(pascal(a), pair), F.concat(camel(a), pair), F.concat(pascal(a), triple), F.concat(camel(a), triple)), lambda x: x.isNotNull())

    return F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), at)))


#: Bytes of text that a task cuts into terms at once, and counts letters of.
TEXT_SLICE = 1 << 22
_COUNTS = ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType())]))


def _slices(texts: pa.Array) -> list[pa.Array]:
    """texts in runs of rows of about TEXT_SLICE bytes, a longer text alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique(np.searchsorted(ends, np.arange(TEXT_SLICE, int(ends[-1]) if len(ends) else 0, TEXT_SLICE)))
    cuts = [0, *[int(c) for c in cuts if c > 0], len(texts)]
    return [texts.slice(i, j - i) for i, j in zip(cuts, cuts[1:])]


def _cut(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The row and the term of all terms of texts, in order: by the same regular expressions and case mapping as the SQL's engine."""
    low = pc.utf8_lower(pc.replace_substring_regex(pc.fill_null(texts.cast(pa.string()), ""), "([a-z0-9])([A-Z])", r"\1 \2"))
    parts = pc.split_pattern_regex(low, r"[^\pL\pN]+")
    rows, terms = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False), pc.list_flatten(parts).dictionary_encode()
    long = pc.greater_equal(pc.utf8_length(terms.dictionary), 2).to_numpy(zero_copy_only=False)[terms.indices.to_numpy(zero_copy_only=False)]
    return rows[long], terms.filter(pa.array(long))


def _offsets(rows: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))


@F.arrow_udf(ArrayType(StringType()))
def _terms(texts: pa.Array) -> pa.Array:
    def of(some: pa.Array) -> pa.Array:
        rows, terms = _cut(some)
        return pa.ListArray.from_arrays(_offsets(rows, len(some)), terms.dictionary_decode(), mask=some.is_null())

    return pa.concat_arrays([of(some) for some in _slices(texts)])


@F.arrow_udf(StructType([StructField("dl", IntegerType()), StructField("counts", _COUNTS)]))
def _counted(texts: pa.Array) -> pa.Array:
    def of(some: pa.Array) -> pa.Array:
        rows, terms = _cut(some)
        keys, tf = np.unique(rows.astype(np.int64) << 32 | terms.indices.to_numpy(zero_copy_only=False), return_counts=True)
        counts = pa.StructArray.from_arrays([terms.dictionary.take(pa.array(keys & 0xFFFFFFFF)), pa.array(tf, pa.int64())], ["term", "tf"])
        dl = pa.array(np.bincount(rows, minlength=len(some)), pa.int32())
        return pa.StructArray.from_arrays([dl, pa.ListArray.from_arrays(_offsets(keys >> 32, len(some)), counts)], ["dl", "counts"])

    return pa.concat_arrays([of(some) for some in _slices(texts)])


def code_terms(text: Column) -> Column:
    """Lower-case index terms of two characters or more; camel case, snake case, dots and slashes separate."""
    return _terms(text)


def term_counts(text: Column) -> Column:
    """The text's code_terms counted where it is, without a shuffle: (dl, counts), the number of them all and an array of each distinct (term, tf)."""
    return _counted(text)


def query_terms(text: Column) -> Column:
    """Distinct terms of an OR query: runs of letters, digits and underscores; the whole query if there are none."""
    words = F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda t: t != ""))
    return F.when(F.size(words) > 0, words).otherwise(F.array(text))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def last_component(symbol: Column) -> Column:
    return F.element_at(F.split(symbol, r"[./#:]+"), -1)


def normal_path(path: Column) -> Column:
    """Without surrounding blanks, back quotes and a leading ./"""
    return F.regexp_replace(F.regexp_replace(path, r"^[\s`]+|[\s`]+$", ""), r"^\./", "")


def one_line(text: Column, most: int = 200) -> Column:
    """Error text on one line, cut to most characters."""
    flat = F.trim(F.translate(text, "\n\r\t", "   "))
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def version_at_least(version: Column, major: int, minor: int) -> Column:
    """Whether a dotted version reaches major.minor; false if it isn't one."""
    parts = F.split(version, r"\.")
    a, b = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2))
    return F.coalesce((a > major) | ((a == major) & (b >= minor)), F.lit(False))


def anchor_kind(kind: Column) -> Column:
    return F.when(kind == "loc", F.lit("loc")).otherwise(F.lit("def"))


def qualified(symbol: Column, path: Column) -> Column:
    """symbol behind its directory's name, unless it is qualified by that already."""
    package = F.regexp_extract(path, "([^/]+)/[^/]*$", 1)
    return F.when((package == "") | symbol.startswith(F.concat(package, F.lit("."))), symbol).otherwise(F.concat(package, F.lit("."), symbol))


def directory_glob(path: Column) -> Column:
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(folder == "", F.lit("**")).otherwise(F.concat(folder, F.lit("/**")))


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles], F.lit(False))


def excerpt(rule: Column, count: Column) -> Column:
    """What a redaction reports: the rule and how often it matched, none of the text."""
    return F.format_string("%s: %d match%s", rule, count, F.when(count == 1, F.lit("")).otherwise(F.lit("es")))


def health(graph_up: Column, vector_up: Column) -> Column:
    """Without the graph nothing can be served; without vectors less."""
    return F.when(~graph_up, F.lit("down")).when(~vector_up, F.lit("degraded")).otherwise(F.lit("ok"))


def alignment_errors(graph_commit: Column, vector_commit: Column, graph_schema: Column, graph_digest: Column, vector_digest: Column) -> Column:
    """Why two snapshots don't belong together."""
    return F.array_compact(
        F.array(
            F.when(graph_commit != vector_commit, F.lit("commit mismatch")),
            F.when(~version_at_least(graph_schema, 1, 19), F.lit("graph schema too old")),
            F.when(graph_digest != vector_digest, F.lit("digest mismatch")),
        )
    )


def path_trail(file: Column, relation: Column, distance: Column) -> Column:
    """Evidence of a neighbour: the seed's file, the relation and how far."""
    return F.format_string("seed:%s:%s:dist=%d", file, relation, distance)


#: What each intent looks for: symbol kinds (none: any), relations, hops.
INTENT_SHAPE = {
    "bug_fix": (("function", "method"), ("called_by", "calls"), 2),
    "feature_add": (("function", "method", "type", "interface"), ("imports", "implements", "references"), 1),
    "refactor": ((), ("called_by", "calls", "references", "implements"), 2),
    "arch_explain": (("type", "interface", "const", "function", "method"), ("imports", "defines", "calls", "implements", "embeds"), 2),
    "test_add": (("function", "method"), ("tested_by", "calls", "called_by"), 1),
    "concurrency_safety": (("function", "method"), ("called_by", "references", "calls"), 2),
    "security": (("function", "method", "interface"), ("called_by", "calls", "references"), 2),
    "docs_update": (("type", "interface", "function", "method"), ("defines", "implements"), 1),
    "qa_review": ((), RELATIONS, 1),
    "": ((), RELATIONS, 1),
}


def kinds_allowed(intent: Column, kind: Column) -> Column:
    """Whether a symbol kind, in any case, is one the intent looks for."""
    out = F.lit(True)
    for name, (kinds, _, _) in INTENT_SHAPE.items():
        if kinds:
            out = F.when(intent == name, F.lower(kind).isin(*kinds)).otherwise(out)
    return out


def _by_intent(intent: Column, value, default: Column) -> Column:  # noqa: ANN001
    out = default
    for name, shape in INTENT_SHAPE.items():
        out = F.when(intent == name, value(shape)).otherwise(out)
    return out


def intent_relations(intent: Column) -> Column:
    """The relations to walk for an intent; all for an unknown one."""
    names = lambda relations: F.array(*[F.lit(r) for r in relations])
    return _by_intent(intent, lambda s: names(s[1]), names(RELATIONS))


def intent_hops(intent: Column) -> Column:
    return _by_intent(intent, lambda s: F.lit(s[2]), F.lit(1))


def intent_glob(intent: Column) -> Column:
    """A path glob to search besides; only tests have one."""
    return F.when(intent == "test_add", F.lit(TEST_GLOB)).otherwise(F.lit(""))


def edge_valid(source: Column, target: Column, relation: Column, distance: Column) -> Column:
    return F.coalesce((source != "") & (target != "") & relation.isin(*RELATIONS) & (distance >= 1), F.lit(False))


#: Kinds of steps of a trace.
STEP_KINDS = ("recall", "keyword", "find_symbol", "subgraph", "impact")


def hit_valid(file: Column, start: Column, end: Column, rank: Column) -> Column:
    """A valid citation at rank 1 or later; any score will do."""
    return citation_valid(file, start, end) & F.coalesce(rank >= 1, F.lit(False))


def neighbour_valid(source: Column, target: Column, relation: Column, distance: Column) -> Column:
    """Two valid citations (structs of file, start_line, end_line), a known relation, a distance of 1 or more."""
    ends = [citation_valid(c["file"], c["start_line"], c["end_line"]) for c in (source, target)]
    return ends[0] & ends[1] & F.coalesce(relation.isin(*RELATIONS) & (distance >= 1), F.lit(False))


def intent_valid(intent: Column) -> Column:
    return F.coalesce(intent.isin(*INTENTS), F.lit(False))


def trace_valid(prompt: Column, producer: Column, kinds: Column) -> Column:
    """A prompt, a producer, and steps, all of known kinds (array of strings)."""
    steps = (F.size(kinds) > 0) & F.forall(kinds, lambda k: F.coalesce(k.isin(*STEP_KINDS), F.lit(False)))
    return F.coalesce((prompt != "") & (producer != "") & steps, F.lit(False))


def pack_valid(query: Column, intent: Column, citations: Column, bodies: Column, edges: Column) -> Column:
    """A query, a known intent, bodies among the citations and both ends of every edge among them."""
    inside = F.forall(bodies, lambda b: F.array_contains(citations, b))
    linked = F.forall(edges, lambda e: F.array_contains(citations, e["source"]) & F.array_contains(citations, e["target"]))
    return F.coalesce((query != "") & intent.isin(*INTENTS) & inside & linked, F.lit(False))


def plain_words(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower-case ASCII words of three characters or more, in order, without stop words."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*stop) if stop else F.length(w) >= 3)


def hashed_vector(text: Column, dimensions: int = 64) -> Column:
    """A deterministic stand-in for an embedder: signed counts of hashed words, as floats."""
    slots = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.aggregate(slots, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(dimensions)) == i, F.when(h < 0, F.lit(-1.0)).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))).cast("float"))


@F.arrow_udf(ArrayType(FloatType()))
def _letters(texts: pa.Array) -> pa.Array:
    wide = texts.cast(pa.large_binary())
    at = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
    out = np.zeros((len(wide), 26))
    for i in range(len(wide)):
        for begin in range(at[i], at[i + 1], TEXT_SLICE):
            n = np.bincount(data[begin : min(begin + TEXT_SLICE, at[i + 1])], minlength=128)
            out[i] += n[97:123] + n[65:91]
    for letter, other in ((8, "\u0130"), (10, "\u212a")):  # the only others that are a to z in lower case
        out[:, letter] += pc.fill_null(pc.count_substring(texts, other), 0).to_numpy(zero_copy_only=False)
    none = pa.array(np.repeat(texts.is_null().to_numpy(zero_copy_only=False), 26))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(wide) + 1, dtype=np.int32) * 26), pc.if_else(none, pa.scalar(None, pa.float32()), pa.array(out.ravel(), pa.float32())))


def letter_counts(text: Column) -> Column:
    """An even simpler stand-in, which any SQL can repeat: how often each letter a to z stands in the text, in lower case; nulls for a null."""
    return _letters(text)
