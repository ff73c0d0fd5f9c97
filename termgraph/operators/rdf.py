"""OWL triples of classes, hierarchy and properties, and their text forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgraph import vocab
from termgraph.functions import text as T

NAMESPACE = "https://example.org/kg#"
MAX_SIBLINGS = 12
_IRI = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "xsd": "http://www.w3.org/2001/XMLSchema#"}


def _iri(name: str) -> Column:
    prefix, _, local = name.partition(":")
    return F.lit(_IRI[prefix] + local)


def _triple(df: DataFrame, s: Column, p: str, o: Column, literal: bool = False) -> DataFrame:
    kind = F.lit("literal" if literal else "iri")
    return df.select(s.alias("s"), _iri(p).alias("p"), o.alias("o"), kind.alias("kind"), (T.label_lang(o) if literal else F.lit(None).cast("string")).alias("lang"))


def known_classes(classes: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """(name, uri) of the clean class names."""
    return classes.select(T.clean_name("name").alias("name")).where("name <> ''").distinct().withColumn("uri", F.concat(F.lit(namespace), T.local_name("name")))


def collisions(classes: DataFrame) -> DataFrame:
    """(uri, names): class names that share one IRI."""
    return known_classes(classes).groupBy("uri").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") > 1)


def disjoint_pairs(hierarchy: DataFrame, known: DataFrame, max_siblings: int = MAX_SIBLINGS) -> DataFrame:
    """(parent, a, b): sibling classes of parents with 2 to ``max_siblings`` distinct ones, in first-seen order (column ``ord``)."""
    kids = hierarchy.select(T.clean_name("parent").alias("parent"), T.clean_name("child").alias("name"), "ord").where("parent <> ''").join(known, "name")
    one = kids.groupBy("parent", "uri").agg(F.min("ord").alias("ord"))
    sized = one.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("ord", "uri"))).alias("k")).where(F.size("k").between(2, max_siblings))
    pair = F.flatten(F.transform("k", lambda x, i: F.transform(F.slice("k", i + 2, F.size("k")), lambda y: F.struct(x["uri"].alias("a"), y["uri"].alias("b")))))
    return sized.select("parent", F.explode(pair).alias("p")).select("parent", "p.a", "p.b")


def property_triples(props: DataFrame, known: DataFrame, data: bool, namespace: str = NAMESPACE) -> DataFrame:
    """Type, label, domain and range of properties (name, domain, range)."""
    p = props.select(T.clean_name("name").alias("name"), T.clean_name("domain").alias("domain"), F.col("range")).where("name <> ''").withColumn("uri", F.concat(F.lit(namespace), T.local_name("name")))
    k = known.select(F.col("name").alias("k"), F.col("uri").alias("k_uri"))
    out = [_triple(p, F.col("uri"), "rdf:type", _iri("owl:DatatypeProperty" if data else "owl:ObjectProperty")), _triple(p, F.col("uri"), "rdfs:label", F.col("name"), True)]
    out.append(_triple(p.join(k, p.domain == F.col("k")), F.col("uri"), "rdfs:domain", F.col("k_uri")))
    if data:
        kinds = F.create_map(*[F.lit(x) for n in vocab.XSD for full in (f"xsd:{n}", *([n] if n in ("string", "decimal", "integer") else [])) for x in (full, n)])
        out.append(_triple(p, F.col("uri"), "rdfs:range", F.concat(F.lit(_IRI["xsd"]), F.coalesce(kinds[F.col("range")], F.lit("string")))))
    else:
        out.append(_triple(p.join(k, T.clean_name("range") == F.col("k")), F.col("uri"), "rdfs:range", F.col("k_uri")))
    return reduce(DataFrame.unionByName, out)


def ontology(classes: DataFrame, hierarchy: DataFrame, object_props: DataFrame | None = None, data_props: DataFrame | None = None, domain_name: str = "domain", namespace: str = NAMESPACE, max_siblings: int = MAX_SIBLINGS) -> DataFrame:
    """(s, p, o, kind, lang): the distinct triples.  ``classes`` has name, description, parent; ``hierarchy`` parent, child, ord."""
    spark = classes.sparkSession
    known = known_classes(classes, namespace)
    name = known.select(F.col("name").alias("n"), "uri")
    own = classes.select(T.clean_name("name").alias("n"), "description", T.clean_name("parent").alias("parent")).join(name, "n")
    up = known.select(F.col("name").alias("parent"), F.col("uri").alias("p_uri"))
    edges = hierarchy.select(T.clean_name("child").alias("n"), T.clean_name("parent").alias("parent")).unionByName(own.where("parent <> ''").select("n", "parent"))
    head = spark.range(1)
    iri = F.lit(namespace.rstrip("#"))
    parts = [
        _triple(head, iri, "rdf:type", _iri("owl:Ontology")),
        _triple(head, iri, "rdfs:label", F.lit(domain_name), True),
        _triple(known, F.col("uri"), "rdf:type", _iri("owl:Class")),
        _triple(known, F.col("uri"), "rdfs:label", F.col("name"), True),
        _triple(own.where("description <> ''"), F.col("uri"), "rdfs:comment", F.col("description"), True),
        _triple(edges.join(name, "n").join(up, "parent"), F.col("uri"), "rdfs:subClassOf", F.col("p_uri")),
        _triple(disjoint_pairs(hierarchy, known, max_siblings).where("a <> b"), F.col("a"), "owl:disjointWith", F.col("b")),
    ]
    if object_props is not None:
        parts.append(property_triples(object_props, known, False, namespace))
    if data_props is not None:
        parts.append(property_triples(data_props, known, True, namespace))
    return reduce(DataFrame.unionByName, parts).distinct()


def _escaped(c: Column) -> Column:
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def ntriples(triples: DataFrame) -> DataFrame:
    """(line): N-Triples, which is Turtle too."""
    o = F.when(F.col("kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"@'), "lang"))
    return triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("line"))


def rdf_xml(triples: DataFrame) -> DataFrame:
    """(ord, line): RDF/XML, one element a triple between a first and a last line; write it in the order of ``ord``."""
    spark = triples.sparkSession

    def x(c: Column) -> Column:
        for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    local = F.regexp_extract("p", "[^#/]*\\z", 0)
    space = F.regexp_extract("p", "\\A(.*[#/])[^#/]*\\z", 1)
    value = F.when(F.col("kind") == "iri", F.concat(F.lit(' rdf:resource="'), x(F.col("o")), F.lit('"/>'))).otherwise(F.concat(F.lit(' xml:lang="'), "lang", F.lit('">'), x(F.col("o")), F.lit("</p:"), local, F.lit(">")))
    body = F.concat(F.lit('<rdf:Description rdf:about="'), x(F.col("s")), F.lit('"><p:'), local, F.lit(' xmlns:p="'), space, F.lit('"'), value, F.lit("</rdf:Description>"))
    edge = spark.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="' + _IRI["rdf"] + '">'), (2, "</rdf:RDF>")], "ord int, line string")
    return edge.unionByName(triples.select(F.lit(1).alias("ord"), body.alias("line")))


def counts(classes: DataFrame, object_props: DataFrame, data_props: DataFrame) -> DataFrame:
    """One row: the sizes of the inputs."""
    n = lambda d, c: d.agg(F.count(F.lit(1)).alias(c))
    return n(classes, "class_count").crossJoin(n(object_props.select("name").unionByName(data_props.select("name")), "property_count"))
