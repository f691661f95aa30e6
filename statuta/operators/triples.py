"""Triples: graphs from subject-predicate-object rows, and obligations from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.operators.providers import Reply, with_replies
from statuta.operators.verdict import agents_prompt, duty_prompt

#: First words that make a capitalised phrase no agent, and phrases that are none.
NOT_FIRST = ["The", "This", "If", "When", "Where", "In", "On"]
NOT_LOCAL = ["the", "this", "that", "when", "if"]
MOST_AGENTS, LOCAL_AGENTS, PARAGRAPH_BATCH = 50, 3, 8
#: Fixed value: an obligation phrase and what follows it in the sentence.
ACTION = r"(?i)\b(" + "|".join(T.DEONTIC) + r")\b\s+([^.\n]{1,250})"


def static_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of triples (subject, predicate, object, seq); of an edge's predicates the last stays."""
    edges = triples.groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(F.max_by("predicate", "seq").alias("predicate"), F.min("seq").alias("seq"))
    ends = triples.select(F.explode(F.array(F.struct(F.col("subject").alias("id"), (F.col("seq") * 2).alias("s")), F.struct(F.col("object").alias("id"), (F.col("seq") * 2 + 1).alias("s")))).alias("e"))
    nodes = ends.groupBy("e.id").agg(F.min("e.s").alias("seq")).select("id", F.col("id").alias("label"), "seq")
    return nodes, edges


#: The graph that stands in when no triples are given.
TOY_NODES = [
    ("DataController", "Data Controller", "Entity that determines purposes and means of processing personal data"),
    ("DataProcessor", "Data Processor", "Entity that processes personal data on behalf of the controller"),
    ("PersonalData", "Personal Data", "Any information relating to an identified or identifiable natural person"),
]
TOY_EDGES = [("DataController", "PersonalData", "controls"), ("DataProcessor", "PersonalData", "processes")]


def toy_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    nodes = spark.createDataFrame([(*n, k) for k, n in enumerate(TOY_NODES)], "id string, label string, definition string, seq long")
    return nodes, spark.createDataFrame([(*e, k) for k, e in enumerate(TOY_EDGES)], "src string, dst string, predicate string, seq long")


def graph_or_toy(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """static_graph() of triples; the toy graph if there are none."""
    return toy_graph(triples.sparkSession) if triples.isEmpty() else static_graph(triples)


def node_text(nodes: DataFrame, *columns: str) -> Column:
    """What is embedded for a node: its first attribute that is not empty, else its id."""
    return T.falsy_coalesce(*[F.col(c) for c in columns if c in nodes.columns], F.col("id"))


def _contains(text: Column, phrase: Column, any_case: bool) -> Column:
    """Whether text has phrase as whole words."""
    quoted = F.regexp_replace(phrase, r"([^\p{L}\p{N}\s])", r"\\$1")  # every mark stands for itself
    return F.regexp_like(text, F.concat(F.lit("(?i)" if any_case else ""), F.lit(r"\b"), quoted, F.lit(r"\b")))


def _first_present(agents: Column, text: Column, any_case: bool) -> Column:
    return F.get(F.filter(agents, lambda a: _contains(text, a, any_case)), 0)


def heuristic_triples(docs: DataFrame) -> DataFrame:
    """doc_id, pos, agent, deontic, action: one for each sentence with an obligation phrase.

    The agent is the first capitalised phrase of the document that the sentence
    has, else the document's first, else Unknown.
    """
    names = F.array_distinct(T.proper_nouns(F.col("text")))
    agents = F.slice(F.filter(names, lambda a: ~F.regexp_extract(a, r"^(\S+)", 1).isin(NOT_FIRST)), 1, MOST_AGENTS)
    rows = docs.where(T.has_deontic(F.col("text"))).select("doc_id", agents.alias("agents"), F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("pos", "s"))
    found = rows.where(T.has_deontic(F.col("s"))).withColumn("deontic", F.regexp_extract("s", "(?i)" + T.DEONTIC_PATTERN, 1))
    at = F.regexp_instr("s", F.lit("(?i)" + T.DEONTIC_PATTERN))
    action = T.strip(F.substring(F.col("s"), at + F.length("deontic"), F.length("s")))
    agent = F.coalesce(_first_present(F.col("agents"), F.col("s"), False), F.get("agents", 0), F.lit("Unknown"))
    return found.select("doc_id", "pos", agent.alias("agent"), "deontic", action.alias("action"))


def deontic_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, para_pos, para, batch of the paragraphs with an obligation phrase."""
    rows = docs.where(T.has_deontic(F.col("text"))).select("doc_id", F.posexplode(F.filter(T.paragraphs(F.col("text")), T.has_deontic)).alias("para_pos", "para"))
    return rows.withColumn("batch", F.floor(F.col("para_pos") / PARAGRAPH_BATCH))


def document_agents(docs: DataFrame) -> DataFrame:
    """doc_id, agents: the capitalised phrases of the obligation paragraphs, in order of appearance.

    Without a model these stand for its answer; paragraphs are never put together
    with those of other documents.
    """
    paras = F.filter(T.paragraphs(F.col("text")), T.has_deontic)
    # phrases may run over the break that joins paragraphs of one batch
    batches = F.transform(F.sequence(F.lit(0), F.greatest(F.size("paras") - 1, F.lit(0)), F.lit(PARAGRAPH_BATCH)), lambda i: F.array_join(F.slice("paras", i + 1, PARAGRAPH_BATCH), "\n\n"))
    found = F.array_distinct(F.flatten(F.transform(batches, lambda b: F.filter(T.proper_nouns(b), lambda a: F.length(a) > 1))))
    rows = docs.where(T.has_deontic(F.col("text"))).select("doc_id", "text", paras.alias("paras"))
    listed = rows.select("doc_id", "text", found.alias("agents"))
    fallback = F.slice(F.array_distinct(T.proper_nouns(F.col("text"))), 1, MOST_AGENTS)
    return listed.select("doc_id", F.when(F.size("agents") > 0, F.col("agents")).otherwise(fallback).alias("agents"))


def first_of_each(rows: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """Of rows with equal keys, the first in order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def eventic_triples(docs: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """doc_id, para_pos, match_pos, agent, deontic, action; the first of triples equal but for case and outer space.

    agents (doc_id, agents) may come from a model; document_agents() is the default.
    """
    agents = agents if agents is not None else document_agents(docs)
    rows = deontic_paragraphs(docs).join(agents, "doc_id", "left").withColumn("agents", F.coalesce("agents", F.array().cast("array<string>")))
    listed = F.filter("agents", lambda a: _contains(F.col("para"), a, True))
    nearby = F.slice(F.filter(T.proper_nouns(F.col("para"), 2), lambda a: ~F.lower(a).isin(NOT_LOCAL)), 1, LOCAL_AGENTS)
    chosen = F.coalesce(F.get(F.when(F.size(listed) > 0, listed).otherwise(nearby), 0), F.get("agents", 0), F.lit("Unknown"))
    both = F.arrays_zip(F.regexp_extract_all("para", F.lit(ACTION), F.lit(1)).alias("deontic"), F.regexp_extract_all("para", F.lit(ACTION), F.lit(2)).alias("action"))
    found = rows.select("doc_id", "para_pos", T.strip(chosen).alias("agent"), F.posexplode(both).alias("match_pos", "m"))
    made = found.select("doc_id", "para_pos", "match_pos", "agent", T.strip(F.col("m.deontic")).alias("deontic"), T.strip(F.col("m.action")).alias("action"))
    return first_of_each(made, [F.col("doc_id"), F.lower("agent"), F.lower("deontic"), F.lower("action")], ["para_pos", "match_pos"])


def unmatched_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, para_pos, para of paragraphs that have an obligation phrase but no action after it: those a model may be asked about."""
    return deontic_paragraphs(docs).where(~F.regexp_like("para", F.lit(ACTION))).drop("batch")


def asked_triples(docs: DataFrame, provider: Reply, agents: DataFrame | None = None) -> DataFrame:
    """doc_id, para_pos, match_pos, agent, deontic, action that a model gives for the unmatched paragraphs.

    A paragraph is asked about for the first agent of its document that it names; a
    reply without both keys, or with a null or blank action, gives no row.
    """
    agents = agents if agents is not None else document_agents(docs)
    rows = unmatched_paragraphs(docs).join(agents, "doc_id").withColumn("agent", _first_present(F.col("agents"), F.col("para"), True)).where("agent is not null")
    asked = with_replies(rows.select("doc_id", "para_pos", "agent", duty_prompt(F.col("para"), F.col("agent")).alias("prompt")), provider)
    told = F.from_json("reply", "deontic string, action string")
    made = asked.select("doc_id", "para_pos", F.lit(0).alias("match_pos"), T.strip(F.col("agent")).alias("agent"), T.strip(told["deontic"]).alias("deontic"), T.strip(told["action"]).alias("action"))
    return made.where("deontic <> '' and action <> ''")


def asked_agents(docs: DataFrame, provider: Reply) -> DataFrame:
    """doc_id, agents that a model lists for each document with an obligation phrase; those of document_agents() where it lists none."""
    rows = docs.where(T.has_deontic(F.col("text"))).select("doc_id", agents_prompt(F.col("text")).alias("prompt"))
    told = with_replies(rows, provider).select("doc_id", T.split_list(F.coalesce("reply", F.lit(""))).alias("told"))
    both = document_agents(docs).join(told, "doc_id")
    return both.select("doc_id", F.when(F.size("told") > 0, F.slice(F.array_distinct("told"), 1, MOST_AGENTS)).otherwise(F.col("agents")).alias("agents"))


def all_eventic_triples(docs: DataFrame, provider: Reply | None = None) -> DataFrame:
    """eventic_triples(), and with a provider its agents and what it says of the paragraphs without an action."""
    if provider is None:
        return eventic_triples(docs)
    agents = asked_agents(docs, provider)
    both = eventic_triples(docs, agents).unionByName(asked_triples(docs, provider, agents))
    return first_of_each(both, [F.col("doc_id"), F.lower("agent"), F.lower("deontic"), F.lower("action")], ["para_pos", "match_pos"])


def eventic_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes id, type, seq; edges src, dst, rel, seq) of triples (agent, deontic, action, seq)."""
    deontic, action = F.concat(F.lit("DEONTIC::"), "deontic"), F.concat(F.lit("ACTION::"), "action")
    node = lambda c, kind, k: F.struct(c.alias("id"), F.lit(kind).alias("type"), (F.col("seq") * 3 + k).alias("s"))
    ends = triples.select(F.explode(F.array(node(F.col("agent"), "agent", 0), node(deontic, "deontic", 1), node(action, "action", 2))).alias("n"))
    nodes = ends.groupBy("n.id").agg(F.max_by("n.type", "n.s").alias("type"), F.min("n.s").alias("seq"))
    edge = lambda a, b, rel, k: F.struct(a.alias("src"), b.alias("dst"), F.lit(rel).alias("rel"), (F.col("seq") * 2 + k).alias("s"))
    links = triples.select(F.explode(F.array(edge(F.col("agent"), deontic, "has_deontic", 0), edge(deontic, action, "regulates", 1))).alias("e"))
    edges = links.groupBy("e.src", "e.dst").agg(F.max_by("e.rel", "e.s").alias("rel"), F.min("e.s").alias("seq"))
    return nodes, edges
