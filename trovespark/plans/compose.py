"""The retrieval pipeline over a batch of prompts: classify, extract keywords in rounds, search and fuse, expand, allocate, sanitize, assemble.

Every stage is a DataFrame of (prompt_id, ...). The corpus is (doc, file, start_line, end_line, commit_hash, symbol, chunk_kind, text, vec);
embed makes vectors of the same kind from prompts. Its graph, nodes (id, ...) and edges (src, dst, type), names nodes by doc.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from trovespark.functions.text import INTENT_SHAPE, TEST_GLOB, basename, citation_key, code_terms, compounds, glob_regex, hashed_vector, identifiers, intent_glob, intent_hops, intent_relations, kinds_allowed
from trovespark.operators import graph, inventory
from trovespark.operators.budget import KNOWLEDGE, Budget, allocate
from trovespark.operators.pack import assemble
from trovespark.operators.ranking import WEIGHTS, citation_order, confidence, demote_tests, first_wins, reciprocal_rank_fusion, top_k
from trovespark.operators.sanitize import BASELINE, Rule, sanitize
from trovespark.operators.search import bm25, classify, knn, postings, stats_of
from trovespark.sources.scratch import kept

#: Words that are no keywords.
STOPWORDS = "the and for but with this that from into have are was were been being what when where which who how why does did doing".split()


@dataclass(frozen=True)
class Settings:
    recall: int = 20
    rerank: int = 5
    keywords: int = 8
    bm25: int = 10
    citations: int = 30
    seeds: int = 10
    per_seed: int = 50
    neighbours: int = 50
    confidence: float = 0.5
    augment: int = 3
    knowledge: int = 6


Embed = Callable[[Column], Column]


@dataclass(frozen=True)
class Extraction:
    """What stage 1 leaves: keywords (prompt_id, pos, keyword), hits (prompt_id, pos, doc), rounds (prompt_id, round, hits, confidence), asked (prompt_id, round, query), vocabulary (prompt_id, added array)."""

    keywords: DataFrame
    hits: DataFrame
    rounds: DataFrame
    asked: DataFrame
    vocabulary: DataFrame


def keyword_array(text: Column) -> Column:
    words = F.filter(identifiers(text), lambda w: ~F.lower(w).isin(STOPWORDS))
    return F.concat(compounds(words), words)


def candidates(prompts: DataFrame, hits: DataFrame) -> DataFrame:
    """(prompt_id, pos, keyword): the prompt's own keywords, then of each hit (prompt_id, rank, symbol, file), at most Settings.recall of a prompt, its symbol or its file's stem."""
    stem = F.regexp_replace(F.regexp_replace(basename(F.col("file")), r"\.[^.]*$", ""), "_test$", "")
    name = F.when(F.coalesce("symbol", F.lit("")) == "", stem).otherwise(F.col("symbol"))
    named = hits.groupBy("prompt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", name.alias("name")))), lambda x: x["name"]).alias("named"))
    listed = prompts.select("prompt_id", keyword_array(F.col("text")).alias("own")).join(named, "prompt_id", "left")
    all_ = F.array_distinct(F.concat("own", F.coalesce("named", F.array().cast("array<string>"))))
    return listed.select("prompt_id", F.posexplode(all_).alias("pos", "keyword"))


def augmented(prompts: DataFrame, words: DataFrame, most: int = 3) -> DataFrame:
    """prompts with augmented: the text and its first keywords (prompt_id, pos, keyword)."""
    first = words.where(F.col("pos") < most).groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("pos", "keyword"))).alias("w"))
    joined = prompts.join(first, "prompt_id", "left")
    return joined.withColumn("augmented", F.concat_ws(" ", "text", F.array_join(F.transform("w", lambda x: x["keyword"]), " "))).drop("w")


def trace_steps(rounds: DataFrame, lexical: DataFrame) -> DataFrame:
    """(prompt_id, pos, kind, decision, hits): a recall step for each round (prompt_id, round, hits), the last accepted, then a keyword step (prompt_id, hits)."""
    w = Window.partitionBy("prompt_id").orderBy(F.desc("round"))
    recall = rounds.withColumn("_n", F.row_number().over(w))  # rounds are two at most
    recall = recall.select("prompt_id", F.col("round").cast("int").alias("pos"), F.lit("recall").alias("kind"), F.when(F.col("_n") == 1, "accept").otherwise("augment").alias("decision"), "hits")
    last = rounds.groupBy("prompt_id").agg((F.max("round") + 1).cast("int").alias("pos"))
    words = lexical.join(last, "prompt_id").select("prompt_id", "pos", F.lit("keyword").alias("kind"), F.lit("expand").alias("decision"), "hits")
    return recall.unionByName(words)


def reranked_keywords(candidates: DataFrame, hits: DataFrame, most: int = 8) -> DataFrame:
    """(prompt_id, keyword, score, rank): keywords by the best score any of their hits (prompt_id, keyword, score) has; those without go."""
    best = hits.groupBy("prompt_id", "keyword").agg(F.max("score").alias("score")).where("score > 0")
    return top_k(candidates.join(best, ["prompt_id", "keyword"]), ["prompt_id"], [F.desc("score"), F.asc("pos")], most)


def present(asked: DataFrame, index: DataFrame) -> DataFrame:
    """The distinct terms of asked (term), a written table, that the index holds: its other terms don't come to a shuffle."""
    return index.select("term").join(asked.select("term").distinct(), "term", "left_semi").distinct()


def known_keywords(words: DataFrame, index: DataFrame) -> DataFrame:
    """words (prompt_id, pos, keyword) of which keyword search finds anything, with score 1.

    A keyword's score is that of its best hit, and scores of a search are scaled so that the best is 1:
    so it is enough to ask the index for any of its terms.
    """
    terms = kept(words.select("keyword").distinct().select("keyword", F.explode(F.array_distinct(code_terms(F.col("keyword")))).alias("term")), "asked-terms")
    found = terms.join(present(terms, index), "term", "left_semi").select("keyword").distinct()
    return words.join(found, "keyword", "left_semi").withColumn("score", F.lit(1.0))


def extract(prompts: DataFrame, corpus: DataFrame, index: DataFrame, glossary: list[tuple[list[str], list[str]]] = (), settings: Settings = Settings(), embed: Embed = hashed_vector) -> Extraction:
    """Keywords and vector hits of prompts (prompt_id, text), in two rounds at most.

    A round recalls by vector, takes keyword candidates from the prompt and all hits so far, and keeps
    those that keyword search knows. A prompt whose best keyword holds less than Settings.confidence of
    all scores goes on to a second round with its first keywords added to the expanded text. The
    knowledge pass then adds the nearest invariants and conventions behind the other hits. Hits are
    merged by citation, the first of repeats staying.
    """
    with_words = inventory.expand(prompts.select("prompt_id", "text"), list(glossary))
    expanded = with_words.select("prompt_id", "text", "expanded")
    place = corpus.select("doc", "file", "start_line", "end_line", "symbol")

    def recalled(asked: DataFrame, query: str, vectors: DataFrame, k: int, round_: int) -> DataFrame:
        near = knn(asked.select(F.col("prompt_id").alias("query_id"), embed(F.col(query)).alias("vec")), vectors.select("doc", "vec"), k=k)
        return near.select(F.col("query_id").alias("prompt_id"), "doc", F.lit(round_).alias("round"), "rank").join(place, "doc")

    def merged(hits: DataFrame) -> DataFrame:
        """With pos from 1; a prompt has Settings.recall hits a round and Settings.knowledge more, at most."""
        once = first_wins(hits, ["prompt_id", "file", "start_line", "end_line"], [F.asc("round"), F.asc("rank")])
        return once.withColumn("pos", F.row_number().over(Window.partitionBy("prompt_id").orderBy("round", "rank")))

    def named(asked: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The keywords of the hits so far, and how sure they are."""
        found = kept(known_keywords(candidates(asked, merged(hits).select("prompt_id", F.col("pos").alias("rank"), "symbol", "file")), index), "known-keywords")
        return found, asked.select("prompt_id").join(confidence(found, ["prompt_id"]), "prompt_id", "left").fillna(0.0, ["confidence"])

    first = kept(recalled(expanded, "expanded", corpus, settings.recall, 1), "round1")
    words1, sure1 = named(expanded, first)
    again = kept(expanded.join(sure1.where(F.col("confidence") < settings.confidence), "prompt_id", "left_semi"), "unsure")
    ranked = lambda words: words.withColumn("pos", F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("score"), "pos")) - 1)
    asked = augmented(again.select("prompt_id", F.col("expanded").alias("text")), ranked(words1), settings.augment)
    second = kept(recalled(asked, "augmented", corpus, settings.recall, 2), "round2")
    both = first.join(again, "prompt_id", "left_semi").unionByName(second)
    words2, sure2 = named(again, both)
    words = words1.join(again, "prompt_id", "left_anti").unionByName(words2)
    rules = recalled(expanded, "expanded", corpus.where(F.col("chunk_kind").isin(*KNOWLEDGE)), settings.knowledge, 3)
    counted = lambda hits, sure, n: sure.join(merged(hits).groupBy("prompt_id").agg(F.count("*").alias("hits")), "prompt_id", "left").select("prompt_id", F.lit(n).alias("round"), F.coalesce("hits", F.lit(0)).alias("hits"), "confidence")
    return Extraction(
        ranked(words).where(F.col("pos") < settings.keywords).select("prompt_id", "pos", "keyword"),
        merged(first.unionByName(second).unionByName(rules)).select("prompt_id", "pos", "doc"),
        counted(first, sure1, 1).unionByName(counted(both, sure2, 2)),
        expanded.select("prompt_id", F.lit(1).alias("round"), F.col("expanded").alias("query")).unionByName(asked.select("prompt_id", F.lit(2).alias("round"), F.col("augmented").alias("query"))),
        with_words.select("prompt_id", F.col("keywords").alias("added")),
    )


def traces(prompts: DataFrame, found: Extraction, seeds: DataFrame, corpus: DataFrame, index: DataFrame) -> DataFrame:
    """How each prompt (prompt_id, intent, text) came by its seeds: one row (prompt_id, producer, intent, prompt, vocab_expanded, vocab_keywords, steps, final_seeds, failed_keywords, rounds, vector_calls, graph_calls).

    steps has a recall step for each round, the last accepted with keywords, confidence and hits, the one before
    augmented, then a keyword step. A keyword failed if the index holds none of its terms. All arrays are bounded by Settings.
    """
    key = citation_key(F.col("file"), F.col("start_line"), F.col("end_line"))
    place = corpus.select("doc", key.alias("key"))
    in_order = lambda df, by, what, name: df.groupBy("prompt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x[what]).alias(name))
    words = in_order(found.keywords, "pos", "keyword", "keywords")
    hits = in_order(found.hits.join(place, "doc"), "pos", "key", "hits")
    best = in_order(seeds.select("prompt_id", "rank", key.alias("key")), "rank", "key", "final_seeds")
    terms = kept(found.keywords.select("prompt_id", "pos", "keyword", F.explode_outer(F.array_distinct(code_terms(F.col("keyword")))).alias("term")), "traced-terms")
    terms = terms.join(present(terms, index).withColumn("_there", F.lit(True)), "term", "left")
    failed = in_order(terms.groupBy("prompt_id", "pos", "keyword").agg(F.max("_there").alias("there")).where("there is null"), "pos", "keyword", "failed_keywords")
    rounds = found.rounds.join(found.asked, ["prompt_id", "round"], "left").groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("round", "query", "confidence"))).alias("rounds"))
    out = prompts.select("prompt_id", "intent", "text").join(rounds, "prompt_id")
    for part in (words, hits, best, failed, found.vocabulary.withColumnRenamed("added", "vocab_keywords")):
        out = out.join(part, "prompt_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("keywords", "hits", "final_seeds", "failed_keywords", "vocab_keywords")})
    none, n = F.array().cast("array<string>"), F.size("rounds")

    def step(r: Column) -> Column:
        last = r["round"] == n
        told = lambda x: F.when(last, x).otherwise(none)
        return F.struct(r["round"].cast("int").alias("n"), F.lit("recall").alias("kind"), r["query"].alias("query"), F.lit("vector").alias("source"), F.when(last, "accept").otherwise("augment").alias("decision"), told(F.col("keywords")).alias("keywords"), F.when(last, r["confidence"]).alias("confidence"), told(F.col("hits")).alias("hits"))

    kind = "array<struct<n:int,kind:string,query:string,source:string,decision:string,keywords:array<string>,confidence:double,hits:array<string>>>"
    words_step = F.array(F.struct((n + 1).cast("int"), F.lit("keyword"), F.array_join("keywords", " "), F.lit("graph"), F.lit("expand"), F.col("keywords"), F.lit(None).cast("double"), F.col("final_seeds"))).cast(kind)
    return out.select(
        "prompt_id", F.lit("composer").alias("producer"), "intent", F.col("text").alias("prompt"), (F.size("vocab_keywords") > 0).alias("vocab_expanded"), "vocab_keywords",
        F.concat(F.transform("rounds", step).cast(kind), words_step).alias("steps"), "final_seeds", "failed_keywords", n.alias("rounds"), n.alias("vector_calls"), F.lit(0).alias("graph_calls"),
    )


def outcomes(prompts: DataFrame, clean: DataFrame) -> DataFrame:
    """(prompt_id, status, rule) of every prompt (prompt_id, text): ok, empty_prompt (null or blank), or fail_closed with the rule that the first of its bodies (prompt_id, pos, aborted, redactions) to be refused broke."""
    refused = clean.where("aborted").groupBy("prompt_id").agg(F.min_by(F.col("redactions")[0]["rule"], "pos").alias("rule"))
    out = prompts.select(F.col("prompt_id").cast("string").alias("prompt_id"), F.trim(F.coalesce("text", F.lit(""))).alias("_text")).join(refused, "prompt_id", "left")
    status = F.when(F.col("_text") == "", "empty_prompt").when(F.col("rule").isNotNull(), "fail_closed").otherwise("ok")
    return out.select("prompt_id", status.alias("status"), "rule")


class StageEvents:
    """Counts of a batch's stages, observed while the stages are written: they cost no job of their own."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def watch(self, event: str, df: DataFrame, **counts: Column) -> DataFrame:
        self.seen[event] = Observation()
        return df.observe(self.seen[event], F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()])

    def rows(self, spark: SparkSession, run_id: str) -> DataFrame:
        """One event a stage, in order, in the shape of event logs. Every stage must have been written."""
        rows = [(i, event, {k: str(v) for k, v in o.get.items() if v is not None}) for i, (event, o) in enumerate(self.seen.items())]
        logged = spark.createDataFrame(rows, "place int, event string, fields map<string,string>")
        ts = F.current_timestamp() + F.make_interval(secs=F.col("place") / 1e6)
        return logged.select(ts.alias("ts"), F.lit("info").alias("level"), "event", F.lit(run_id).alias("trace_id"), F.lit(run_id).alias("run_id"), F.lit(False).alias("dry_run"), "fields")


def search(prompts: DataFrame, found: Extraction, corpus: DataFrame, index: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(prompt_id, doc, file, start_line, end_line, score, evidence, n_lists, ...) for prompts (prompt_id, intent).

    Fused are the merged vector hits, for each keyword a BM25 list and a list of symbols of the kinds its
    intent looks for, and for intents with a path glob another BM25 list of the files that match it. Test
    paths count less unless tests are asked for.
    """
    words = kept(found.keywords.join(prompts.select("prompt_id", "intent"), "prompt_id"), "keywords")
    place = corpus.select("doc", "file", "start_line", "end_line", "commit_hash", "chunk_kind")
    named = lambda df, kind: df.select("prompt_id", "doc", "rank", F.lit(kind).alias("list_kind"), F.lit(WEIGHTS[kind]).alias("weight"))
    stats = stats_of(index, corpus)
    by_word = words.select(F.col("keyword").alias("query_id"), F.col("keyword").alias("text")).distinct()
    lexical = bm25(by_word, index, stats, k=settings.bm25).withColumnRenamed("query_id", "keyword")
    lists = named(lexical.join(words, "keyword"), "bm25")
    globbed = words.where(intent_glob(F.col("intent")) != "")
    matching = place.where(F.col("file").rlike(glob_regex(TEST_GLOB)))
    extra = bm25(globbed.select(F.col("keyword").alias("query_id"), F.col("keyword").alias("text")).distinct(), index, stats, k=settings.bm25, within=matching)
    lists = lists.unionByName(named(extra.withColumnRenamed("query_id", "keyword").join(globbed, "keyword"), "bm25"))
    symbols = words.join(corpus.select("doc", "chunk_kind", F.col("symbol").alias("keyword")), "keyword").where(kinds_allowed(F.col("intent"), F.col("chunk_kind")))
    lists = lists.unionByName(named(top_k(symbols, ["prompt_id", "keyword"], [F.asc("doc")], settings.bm25), "symbol"))
    lists = lists.unionByName(named(found.hits.withColumnRenamed("pos", "rank"), "vector"))
    fused = reciprocal_rank_fusion(lists, ["prompt_id"], ["doc"]).withColumn("score", F.round("score", 12)).join(place, "doc").join(prompts.select("prompt_id", "intent"), "prompt_id")
    return top_k(demote_tests(fused, intent=F.col("intent")), ["prompt_id"], citation_order(), settings.citations)


def _neighbours_of(best: DataFrame, met: DataFrame, settings: Settings) -> DataFrame:
    """What the walks from the best seeds (prompt_id, node, score) met, as scored neighbours."""
    scored = met.join(best.select(F.concat_ws("|", "prompt_id", "node").alias("seed"), "prompt_id", "node", "score"), "seed").withColumn("score", F.col("score") / (1 + F.col("distance")))
    scored = scored.withColumnRenamed("node", "from_seed").join(best.select("prompt_id", F.col("node").alias("target")), ["prompt_id", "target"], "left_anti")
    reached = scored.groupBy("prompt_id", "target").agg(F.array_sort(F.collect_set("from_seed")).alias("seeds"))  # Settings.seeds at most
    one = top_k(scored, ["prompt_id", "target"], [F.desc("score"), F.asc("source"), F.asc("relation")], 1, "_r").drop("_r", "seed", "from_seed")
    return top_k(one.join(reached, ["prompt_id", "target"]), ["prompt_id"], [F.desc("score"), F.asc("target")], settings.neighbours)


def expand(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, relations: list[str], settings: Settings = Settings(), hops: int = 1) -> DataFrame:
    """(prompt_id, source, target, relation, distance, score, seeds, rank): neighbours of the best seeds (prompt_id, node, score); seeds themselves are no neighbours.

    Of a target's paths the best stays, and seeds lists all that reach it.
    """
    best = top_k(seeds, ["prompt_id"], [F.desc("score"), F.asc("node")], settings.seeds)
    met = graph.neighbours(best.select(F.concat_ws("|", "prompt_id", "node").alias("seed"), "node"), edges, nodes, relations, hops, settings.per_seed)
    return _neighbours_of(best, met, settings)


def relation_coverage(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, relations: list[str], settings: Settings = Settings(), hops: int = 1) -> DataFrame:
    """(prompt_id, relation, n): edges of each relation met from the best seeds, before targets are made distinct."""
    best = top_k(seeds, ["prompt_id"], [F.desc("score"), F.asc("node")], settings.seeds)
    met = graph.neighbours(best.select(F.concat_ws("|", "prompt_id", "node").alias("seed"), "node"), edges, nodes, relations, hops, settings.per_seed)
    return met.groupBy(F.substring_index("seed", "|", 1).alias("prompt_id"), "relation").agg(F.count("*").alias("n"))


def expand_by_intent(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """expand() for seeds (prompt_id, intent, node, score), each prompt over the relations and hops of its intent."""
    best = top_k(seeds, ["prompt_id"], [F.desc("score"), F.asc("node")], settings.seeds)
    intent = F.col("intent")
    walk = best.select(F.concat_ws("|", "prompt_id", "node").alias("seed"), "node", intent_relations(intent).alias("relations"), intent_hops(intent).alias("hops"))
    met = graph.neighbours_by_relations(walk, edges, nodes, settings.per_seed, max(hops for _, _, hops in INTENT_SHAPE.values()))
    return _neighbours_of(best, met, settings)


@dataclass(frozen=True)
class Composition:
    """The stages of a batch: intents, extraction, seeds, neighbours, selected bodies and packs; outcomes has a row for every prompt, traces for those that were searched."""

    intents: DataFrame
    extraction: Extraction
    seeds: DataFrame
    neighbours: DataFrame
    selected: DataFrame
    packs: DataFrame
    outcomes: DataFrame
    traces: DataFrame


def compose(
    prompts: DataFrame,
    corpus: DataFrame,
    anchors: DataFrame | None = None,
    nodes: DataFrame | None = None,
    edges: DataFrame | None = None,
    glossary: list[tuple[list[str], list[str]]] = (),
    rules: list[Rule] = BASELINE,
    budget: Budget = Budget(),
    settings: Settings = Settings(),
    embed: Embed = hashed_vector,
    events: StageEvents | None = None,
) -> Composition:
    """All stages for prompts (prompt_id, text), which end in one stamped pack for each, or in an outcome that says why there is none.

    Without anchors (intent, anchor, vec) every intent is unknown; without a graph there are no
    neighbours. corpus without vec is embedded first. Stages that others read more than once are written, and with
    events, whose counts they give, all of them. Blank prompts aren't searched.
    """
    every, prompts = prompts, prompts.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    watch = events.watch if events else lambda event, df, **counts: df
    some = lambda df, name: kept(df, name) if events else df
    if "vec" not in corpus.columns:
        corpus = corpus.withColumn("vec", embed(F.col("text")))
    corpus = kept(corpus, "corpus")
    index = kept(postings(corpus, "doc"), "postings")
    asked = prompts.select("prompt_id", "text")
    if anchors is None:
        intents = asked.select("prompt_id", F.lit("").alias("intent"))
    else:
        intents = classify(asked.select("prompt_id", embed(F.col("text")).alias("vec")), anchors).select("prompt_id", "intent")
    intents = kept(watch("composer.intent_classified", intents, unknown=F.count_if(F.col("intent") == "")), "intents")
    found = extract(asked, corpus, index, glossary, settings, embed)
    words = some(watch("composer.stage1_extracted", found.keywords, first=F.count_if(F.col("pos") == 0)), "stage1-keywords")
    found = Extraction(words, some(found.hits, "stage1-hits"), some(found.rounds, "stage1-rounds"), found.asked, found.vocabulary)
    seeds = kept(watch("composer.stage2_searched", search(intents, found, corpus, index, settings), top=F.count_if(F.col("rank") == 1), best=F.max("score")), "seeds")
    cited = corpus.select("doc", "file", "start_line", "end_line", "commit_hash", "chunk_kind")
    if nodes is None or edges is None:
        met = seeds.select("prompt_id", F.col("doc").alias("source"), F.col("doc").alias("target"), F.lit("").alias("relation"), F.lit(1).alias("distance"), "score", F.lit(1).alias("rank")).where("false")
    else:
        met = expand_by_intent(seeds.select("prompt_id", "intent", F.col("doc").alias("node"), "score"), nodes, edges, settings)
    met = kept(watch("composer.stage3_expanded", met, hops=F.max("distance")), "neighbours")
    key = citation_key(F.col("file"), F.col("start_line"), F.col("end_line"))
    near = met.select("prompt_id", F.col("target").alias("doc"), "score").join(cited, "doc").withColumn("is_seed", F.lit(False))
    columns = ["prompt_id", "file", "start_line", "end_line", "commit_hash", "chunk_kind", "is_seed", "score"]
    candidates_ = seeds.withColumn("is_seed", F.lit(True)).select(*columns).unionByName(near.select(*columns))
    selected = allocate(candidates_, corpus.select("file", "start_line", "end_line", "text"), budget)
    selected = kept(watch("composer.stage4_allocated", selected, used_tokens=F.sum("tokens"), degraded=F.count_if("degraded"), seeds=F.count_if("is_seed")), "selected")
    clean = watch("composer.stage5_sanitized", sanitize(selected, rules), dropped=F.count_if(F.col("text") == ""), aborted=F.count_if("aborted"), redactions=F.sum(F.size("redactions")))
    clean = some(clean, "clean")
    keys = cited.select("doc", key.alias("key"))
    ends = met.join(keys.select(F.col("doc").alias("source"), F.col("key").alias("source_key")), "source").join(keys.select(F.col("doc").alias("target"), F.col("key").alias("target_key")), "target")
    links = ends.select("prompt_id", F.col("rank").cast("long").alias("pos"), F.col("source_key").alias("source"), F.col("target_key").alias("target"), "relation", "distance")
    asked = asked.join(intents, "prompt_id").select(F.col("prompt_id").cast("string").alias("prompt_id"), "intent", F.col("text").alias("query"))
    packs = watch("composer.compose_complete", assemble(asked, clean, links, budget.usable), citations=F.sum(F.size(F.coalesce("citations", F.array().cast("array<string>")))), used_tokens=F.sum("used_tokens"), edges=F.sum(F.size(F.coalesce(F.transform("edges", lambda e: e["source"]), F.array().cast("array<string>")))))
    traced = traces(prompts.join(intents, "prompt_id"), found, seeds, corpus, index)
    return Composition(intents, found, seeds, met, selected, some(packs, "packs"), outcomes(every, clean), traced)


def composing_tool(corpus: DataFrame, **how: object) -> Callable[[DataFrame], DataFrame]:
    """A tool for evaluation.runner: runs (run_id, prompt) go through compose() as one batch; a pack is a payload, any other outcome an error. Latency is the batch's, shared evenly."""

    def tool(runs: DataFrame) -> DataFrame:
        began = time.monotonic()
        done = compose(runs.select(F.col("run_id").alias("prompt_id"), F.col("prompt").alias("text")), corpus, **how)
        packs = kept(done.packs, "packs")
        cited = F.transform("citations", lambda k: F.struct(F.regexp_extract(k, r"^(.*):\d+-\d+$", 1).alias("file"), F.regexp_extract(k, r":(\d+)-\d+$", 1).cast("int").alias("start_line"), F.regexp_extract(k, r"-(\d+)$", 1).cast("int").alias("end_line")))
        payload = F.to_json(F.struct(F.col("query"), F.col("intent"), F.coalesce(cited, F.array().cast("array<struct<file:string,start_line:int,end_line:int>>")).alias("citations"), F.col("bodies"), F.struct(F.col("used_tokens"), F.col("utilization").alias("utilization_ratio")).alias("metadata")))
        rows = done.outcomes.join(packs.select("prompt_id", payload.alias("structured")), "prompt_id", "left")
        wrong = F.when(F.col("status") != "ok", F.concat_ws(": rule=", "status", "rule"))
        each = int(1000 * (time.monotonic() - began) / max(1, packs.count()))
        return rows.select(F.col("prompt_id").alias("run_id"), "structured", F.lit(None).cast("string").alias("text"), wrong.alias("error"), F.lit(each).cast("long").alias("latency_ms"))

    return tool
