"""A whole build: chunks to classes, hierarchy, typed entities, relations and RDF, as one plan.

Tokens are made once and written to the shared folder, because six stages read them; everything after that is lazy until a table is
written."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgraph import vocab
from termgraph.config import Config, Tools
from termgraph.functions import text as T
from termgraph.operators import dedup, entities, hierarchy, nouns, promotion, rdf, relations, svo, typing
from termgraph.storage import materialise

TRIPLES = "chunk_id string, ord int, subject string, predicate string, object string, inferred_subject boolean, score double"
ENTITIES = "doc_id string, chunk_id string, ord long, entity string, class string, start int, end int, score double"


@dataclass(frozen=True)
class Graph:
    """classes (name, source_chunks), hierarchy (parent, child, src), entities, relations, data_properties (always empty), stats."""

    classes: DataFrame
    hierarchy: DataFrame
    entities: DataFrame
    relations: DataFrame
    data_properties: DataFrame
    stats: DataFrame


def _token_table(texts: DataFrame, load: Callable, name: str = "name") -> DataFrame:
    """(name, tokens) of distinct strings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = load()
        for b in batches:
            out = []
            for s in b["name"]:
                try:
                    out.append([dict(zip(("form", "tag", "start", "len"), t)) for t in read(s)])
                except Exception:
                    out.append(None)
            yield pd.DataFrame({"name": b["name"], "tokens": out})

    return texts.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct().mapInPandas(run, f"name string, tokens {vocab.TOKENS}")


def _ordered(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records with their document and a total order within it."""
    j = records.join(chunks.select("chunk_id", "doc_id", "chunk_seq"), "chunk_id")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_seq", F.coalesce("start", F.lit(1 << 30)), "entity", "class"))
    return j.withColumn("ord", place.cast("long")).select("doc_id", "chunk_id", "ord", "entity", "class", "start", "end", "score")


def build(chunks: DataFrame, tools: Tools, config: Config = Config(), existing: Graph | None = None) -> Graph:
    """The graph of (doc_id, doc_seq, chunk_id, chunk_seq, chunk_text).  A channel whose tool is missing gives nothing."""
    spark = chunks.sparkSession
    routed = nouns.routed(chunks, tools.english_tagger is not None)
    ko = routed.where("ko_nouns")
    mentions = spark.createDataFrame([], "name string, chunk_id string")
    definitions = spark.createDataFrame([], "child string, parent string, chunk_id string")
    triples = spark.createDataFrame([], TRIPLES)
    read = None
    if tools.tokenizer is not None:
        read = materialise(_token_table(ko, tools.tokenizer, "chunk_text").join(ko.select(F.col("chunk_text").alias("name"), "chunk_id"), "name"), "tokens")
        mentions = mentions.unionByName(nouns.korean_nouns(read, ["chunk_id"]).select(F.col("surface").alias("name"), "chunk_id"))
    if tools.english_tagger is not None:
        en = routed.where("en_nouns")
        tagged = _token_table(en, tools.english_tagger, "chunk_text").join(en.select(F.col("chunk_text").alias("name"), "chunk_id"), "name")
        mentions = mentions.unionByName(nouns.english_nouns(tagged, ["chunk_id"], config.domain_words).select(F.col("surface").alias("name"), "chunk_id"))
    if tools.tokenizer is not None and config.definitions:
        definitions = materialise(_definitions(ko, tools.tokenizer), "definitions")
    found = materialise(_entities(routed, tools, config), "mentions")
    if config.relations and channel(tools, config) == "encoder":
        triples = _encoded(ko, found, tools, config)
    elif tools.tokenizer is not None and config.relations:
        triples = relations.korean_triples(relations.tokenised_sentences(ko, tools.tokenizer), config.carry, config.spaced_nouns).withColumn("score", F.lit(None).cast("double"))
    if tools.parser is not None and config.relations and config.english:
        en = routed.where("en_relations").select("chunk_id", F.substring("chunk_text", 1, 2000).alias("chunk_text"))
        triples = triples.unionByName(relations.english_triples(_parsed(en, tools.parser)).withColumns({"inferred_subject": F.lit(False), "score": F.lit(None).cast("double")}))
    if config.definitions:
        remaining, found, edges = typing.definitional_types(definitions, found)
    else:
        remaining, edges = definitions, spark.createDataFrame([], "child string, parent string")
    jobs = spark.createDataFrame([], "child string, parent string")
    if config.occupations and tools.lexicon is not None:
        found, jobs = typing.occupation_types(found, tools.lexicon, routed.where("lang = 'ko'"), config.occupation_evidence)
    found = materialise(found, "entities")
    own = mentions.unionByName(definitions.select(F.col("parent").alias("name"), "chunk_id")).unionByName(remaining.select(F.col("child").alias("name"), "chunk_id"))
    none = F.lit(None).cast("string").alias("chunk_id")
    for extra in (edges.select(F.col("parent").alias("name"), none), jobs.select(F.explode(F.array("child", "parent")).alias("name"), none)):
        own = own.unionByName(extra)
    classes = materialise(nouns.accumulate_classes(own, existing=existing.classes if existing else None), "classes")
    suffix = hierarchy.suffix_hierarchy(classes, tokens=_token_table(classes, tools.tokenizer) if tools.tokenizer is not None else None)
    parts = [*([existing.hierarchy] if existing else []), suffix, remaining, edges, jobs]
    tree = materialise(hierarchy.merged_hierarchy(parts), "hierarchy")
    n = routed.count()
    judged = promotion.build_gate(classes, tree, found, n, config.gate_chunks)
    stats = promotion.gate_stats(judged, n, config.gate_chunks).crossJoin(routed.agg(F.coalesce(F.sum(F.col("skipped_en").cast("int")), F.lit(0)).alias("skipped_en_chunks")))
    triples = triples.withColumn("origin", F.lit("rules"))
    if config.relations and config.topup_when and tools.language_model is not None:
        triples = _topped_up(routed.where("ko_relations"), materialise(triples, "triples"), tools, config)
    rels = triples.select("subject", "predicate", "object", F.lit("ObjectProperty").alias("predicate_type"), F.array("chunk_id").alias("source_chunks"), "inferred_subject", "score", "origin")
    data = spark.createDataFrame([], "entity string, property string, value string, source_chunks array<string>")
    return Graph(judged.where("verdict = 'kept'").drop("verdict"), tree, found, rels, data, stats)


def channel(tools: Tools, config: Config) -> str:
    """Which channel reads Korean relations: the encoder needs its model and an entity model; where one can't be made, rules."""
    if config.relation_channel not in ("auto", "rules", "encoder"):
        raise ValueError("relation_channel is 'auto', 'rules' or 'encoder'")
    if config.relation_channel == "rules" or tools.relation_model is None or tools.ner is None:
        return "rules"
    try:
        tools.relation_model()
    except Exception:
        return "rules"
    return "encoder"


def _encoded(ko: DataFrame, found: DataFrame, tools: Tools, config: Config) -> DataFrame:
    """Triples of the pair classifier over the entities of each sentence."""
    sentences = ko.select("chunk_id", F.posexplode(relations.split_sentences("chunk_text")).alias("sent", "sentence"))
    pairs = relations.candidate_pairs(sentences, found.select("chunk_id", "ord", "entity", "class"))
    got = relations.classified(pairs, tools.relation_model, relations.min_score(config.relation_min_score))
    return got.select("chunk_id", F.lit(0).alias("ord"), "subject", "predicate", "object", F.lit(False).alias("inferred_subject"), "score")


def _topped_up(chunks: DataFrame, triples: DataFrame, tools: Tools, config: Config) -> DataFrame:
    """``triples`` and those of the language model's replies, as far as the budget goes."""
    candidates = relations.topup_candidates(chunks.select("chunk_id", "chunk_text"), triples, config.topup_when)
    budget = relations.Budget(config.topup_max_pct, config.topup_max_usd)
    replies = relations.call_in_order(candidates, budget, chunks.count(), tools.language_model, tools.usage)
    new = relations.topped_up(triples, replies).where("origin = 'topup'")
    return triples.unionByName(new.withColumn("inferred_subject", F.lit(False)), allowMissingColumns=True)


def _definitions(chunks: DataFrame, load: Callable) -> DataFrame:
    """(child, parent, chunk_id): tokens for the pieces and for every name that a pattern may propose."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenize = load()
        memo: dict[str, list] = {}

        def tokens(s: str) -> list:
            if s not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[s] = [hierarchy.Token(t) for t in tokenize(s)]
            return memo[s]

        def alone(s: str) -> bool:
            t = tokens(s)
            return len(s) > 1 and s not in vocab.BOUND and bool(t) and all(x.tag in vocab.NOMINAL for x in t) and t[-1].tag in vocab.NOUNS

        for b in batches:
            out = []
            for cid, pieces in zip(b["chunk_id"], b["pieces"]):
                first = [(s.strip(), tokens(s.strip())) for s in pieces if s.strip()]
                _, text, title = hierarchy.defining_sentence(first)
                own = tokens(text) if text else []
                child = hierarchy._subject(own)
                if not child or (title and child != title.replace(" ", "")) or not any("가" <= c <= "힣" for c in text):
                    continue
                seen = set()
                for run_ in hierarchy._heads(own):
                    nouns_ = [t.form for t in tokens(run_) if t.tag in vocab.NOUNS]
                    ends = ["".join(nouns_[-k:]) for k in range(1, len(nouns_))] if len(nouns_) > 1 else []
                    for p in [*ends, run_]:
                        if p and p != child and p not in seen and p not in vocab.NOT_A_PARENT and alone(p):
                            seen.add(p)
                            out.append((child, p, cid))
            yield pd.DataFrame(out, columns=["child", "parent", "chunk_id"])

    return chunks.select("chunk_id", hierarchy.pieces(F.col("chunk_text")).alias("pieces")).mapInPandas(run, "child string, parent string, chunk_id string")


def _parsed(chunks: DataFrame, load: Callable) -> DataFrame:
    node = "struct<i:int,head:int,text:string,lemma:string,pos:string,dep:string,ent_type:string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = load()
        for b in batches:
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "nodes": [parse(t) for t in b["chunk_text"]]})

    return chunks.mapInPandas(run, f"chunk_id string, nodes array<{node}>")


def _entities(routed: DataFrame, tools: Tools, config: Config) -> DataFrame:
    spark = routed.sparkSession
    out = spark.createDataFrame([], ENTITIES)
    if tools.ner is not None:
        ko = routed.where("lang = 'ko'")
        rows = entities.korean_records(entities.inferred(ko, tools.ner), config.ner_min_score)
        if config.ner_two_pass:
            tail = ko.withColumn("chunk_text", F.substring("chunk_text", entities.MAX_CHARS + 1, entities.MAX_CHARS))
            rows = entities.two_pass(rows, entities.korean_records(entities.inferred(tail, tools.ner), config.ner_min_score))
        head = ko.select("chunk_id", F.substring("chunk_text", 1, entities.MAX_CHARS).alias("head"))
        if tools.tokenizer is not None:
            read = _token_table(head, tools.tokenizer, "head").withColumnRenamed("name", "head")
            rows = entities.aligned(rows.join(head, "chunk_id").join(read, "head"), "head").select("chunk_id", "entity", "class", "start", "end", "score")
        if config.span_gate:
            rows = rows.join(head, "chunk_id").where(entities.border_ok("head", "start", "end")).drop("head")
        base = _ordered(rows, routed)
        if tools.aux_ner is not None:
            more = _ordered(entities.korean_records(entities.inferred(ko, tools.aux_ner), config.ner_min_score), routed)
            base = _ordered(entities.united(base, more).select("chunk_id", "entity", "class", "start", "end", "score"), routed)
        out = out.unionByName(base)
    if tools.english_ner is not None:
        en = routed.where("lang = 'en'")
        out = out.unionByName(_ordered(entities.english_records(entities.inferred(en, tools.english_ner), config.emit_misc), routed))
    if tools.tokenizer is not None:
        read = _token_table(out, tools.tokenizer, "entity").withColumnRenamed("name", "entity")
        return out.join(read, "entity", "left").where(entities.label_ok("entity", "tokens")).select(*[c.split()[0] for c in ENTITIES.split(", ")])
    return out.where(entities.label_ok("entity"))


def renames(graph: Graph, tools: Tools) -> DataFrame:
    """(old, canonical) for classes, then instances, then (if there are any) synonyms."""
    keyed = lambda d, n, o: _keyed(d.select(F.col(n).alias("name"), F.col(o).alias("ord")).where("name <> ''"), tools)
    parts = [dedup.rename_by_key(keyed(graph.classes, "name", "name")), dedup.rename_by_key(keyed(graph.entities, "entity", "ord"))]
    if tools.synonyms is not None:
        names = graph.classes.select("name", F.concat(F.lit("0"), "name").alias("ord")).unionByName(graph.entities.select(F.col("entity").alias("name"), F.concat(F.lit("1"), "doc_id", F.lpad(F.col("ord").cast("string"), 12, "0")).alias("ord")))
        parts.append(dedup.rename_by_synonym(names, tools.synonyms))
    return dedup.flatten_renames(dedup.merge_renames(parts))


def _keyed(names: DataFrame, tools: Tools) -> DataFrame:
    if tools.tokenizer is None:
        return names.withColumn("key", dedup.noun_key("name"))
    clean = names.withColumn("clean", F.regexp_replace(T.strip("name"), dedup.SEPARATORS, ""))
    read = _token_table(clean, tools.tokenizer, "clean").withColumnRenamed("name", "clean")
    return clean.join(read, "clean", "left").withColumn("key", dedup.noun_key("name", "tokens")).drop("clean", "tokens")


def build_full(chunks: DataFrame, tools: Tools, config: Config = Config(), existing: Graph | None = None, domain_name: str = "domain") -> tuple[Graph, DataFrame]:
    """(the graph after dedup, its OWL triples)."""
    g = build(chunks, tools, config, existing)
    if config.dedup:
        r = materialise(renames(g, tools), "rename-map")
        cls = dedup.apply_to_classes(g.classes.withColumn("ord", F.col("name")), r, unite_chunks=config.unite_chunks).drop("ord")
        tree = dedup.apply_to_hierarchy(g.hierarchy, r).withColumn("src", F.lit(0))
        g = replace(g, classes=cls, hierarchy=tree, entities=dedup.apply_to_entities(g.entities, r), relations=dedup.apply_to_relations(g.relations, r))
    tree = g.hierarchy.withColumn("ord", F.xxhash64("parent", "child"))
    cls = g.classes.withColumns({"description": F.lit(""), "parent": F.lit(None).cast("string")})
    return g, rdf.ontology(cls, tree, domain_name=domain_name, namespace=config.namespace, max_siblings=config.max_siblings)
