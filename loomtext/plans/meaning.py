"""Registered queries of trees, chunk trees, categorial grammar, formulas, discourse and inference, over derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import arrow
from loomtext.operators import inference
from loomtext.plans import structures
from loomtext.plans.models import table, words


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_id, tree: the parses of all customers' order states; nodes have one or two children."""
    return structures._parsed(spark, sf_dir).select(F.col("o_custkey").alias("tree_id"), "tree")


def _node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _trees(spark, sf_dir).select("tree_id", F.explode(arrow.tree_nodes(F.col("tree"))).alias("n"))
    return got.select("tree_id", "n.*")


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y2: leaves in order and their number."""
    leaf = F.array_sort(F.collect_list(F.when(F.col("leaf"), F.struct("node", "label"))))
    got = _node_table(spark, sf_dir).groupBy("tree_id").agg(leaf.alias("l"))
    return got.select("tree_id", F.array_join(F.col("l.label"), " ").alias("leaves"), F.size("l").cast("bigint").alias("n"))


_STATES = "w AS (SELECT o_custkey AS tree_id, list(o_orderstatus ORDER BY o_orderkey) AS w FROM orders GROUP BY 1 HAVING count(*) > 1)"


def _heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y2: height: 1 + that of the highest child."""
    got = _trees(spark, sf_dir).select("tree_id", F.explode(arrow.tree_positions(F.col("tree"))).alias("p"))
    return got.groupBy("tree_id").agg((F.max(F.size("p")) + 1).cast("bigint").alias("height"))


def _productions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y3 over the node table: a parent's children in order."""
    n = _node_table(spark, sf_dir)
    shown = F.when(F.col("leaf"), F.concat(F.lit("'"), "label", F.lit("'"))).otherwise(F.col("label"))
    right = n.filter("parent >= 0").groupBy("tree_id", F.col("parent").alias("node")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("child", shown.alias("s"))))["s"], " ").alias("right"))
    return n.select("tree_id", "node", "label").join(right, ["tree_id", "node"]).select("tree_id", "node", F.concat_ws(" -> ", "label", "right").alias("production"))


def _subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y4, with a filter: the subtrees whose label is P."""
    got = _trees(spark, sf_dir).select("tree_id", F.posexplode(arrow.tree_texts(F.col("tree"))).alias("node", "subtree"))
    return got.filter(F.col("subtree").startswith("(P "))


def _chunk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns, chunked, as trees, and back."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", words().alias("w"))
    tagged = t.select("conv_id", "turn", F.transform("w", lambda x: F.struct(x.alias("word"), F.when(x.endswith("s"), "NNS").otherwise("NN").alias("tag"))).alias("t"))
    chunked = tagged.select("conv_id", "turn", "t", arrow.chunks(F.col("t"), "NP: {<NN>+<NNS>}").alias("iob")).filter(F.size("t") > 0)
    return chunked.select("conv_id", "turn", arrow.iob_tree(F.col("t"), F.col("iob")).alias("tree"))


def _lexicon(spark: SparkSession) -> DataFrame:
    rows = [("cold", "N/N"), ("small", "N/N"), ("large", "N/N"), ("hot", "N/N"), ("widget", "N"), ("bolt", "N"), ("bolt", "NP")]
    return spark.createDataFrame(rows, "word string, category string")


def _ccg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the words of all part names."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sent_id"), F.posexplode(F.split(F.lower("p_name"), " ")).alias("pos", "word"))
    return inference.ccg_parse(p, _lexicon(spark)).select("sent_id", F.array_join("derivations", "; ").alias("derivations"))


_ADJECTIVES = "('cold', 'small', 'large', 'hot')"


def _ccg_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return inference.ccg_lookup(_lexicon(spark), p)


def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula for each customer: an application to its segment, to be simplified."""
    c = table(spark, sf_dir, "customer").withColumn("seg", F.lower("c_mktsegment"))
    text = F.concat(F.lit("(\\P.exists x."), F.lit("(P(x) & -rich(x)))(\\y."), "seg", F.lit("(y))"))
    return c.select("c_custkey", text.alias("formula"))


def _simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("formula")
    return _formulas(spark, sf_dir).select("c_custkey", arrow.canonical_formula(f).alias("formula"), arrow.simplified_formula(f).alias("simple"), F.array_join(arrow.free_variables(f), ",").alias("free"))


_FORMULAS = r"""SELECT c_custkey, '(\P.exists x.(P(x) & -rich(x)))(\y.' || lower(c_mktsegment) || '(y))' AS formula, 'exists x.((\y.' || lower(c_mktsegment) || '(y))(x) & -rich(x))' AS raw,
  'exists x.(' || lower(c_mktsegment) || '(x) & -rich(x))' AS simple, 'rich,' || lower(c_mktsegment) AS free FROM customer"""


def _holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all, and whether some, of a customer's orders are finished: models made of the orders."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.concat(F.lit("o"), "o_orderkey")).alias("domain"), F.collect_list(F.when(F.col("o_orderstatus") == "F", F.array(F.concat(F.lit("o"), "o_orderkey")))).alias("done"))
    model = F.to_json(F.struct(F.struct(F.col("done").alias("done")).alias("valuation"), "domain"))
    return o.select("o_custkey", arrow.formula_holds(F.lit("all x.done(x)"), model).alias("every"), arrow.formula_holds(F.lit("exists x.done(x)"), model).alias("some"))


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a discourse."""
    drs = F.concat(F.lit("([x"), "l_linenumber", F.lit("],[item(x"), "l_linenumber", F.lit("), "), F.lower("l_returnflag"), F.lit("(x"), "l_linenumber", F.lit(")])"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("thread"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("turn"), drs.alias("drs"))
    return inference.threads(rows).select("thread", F.col("n").cast("bigint").alias("n"), "merged", "fol")


_THREADS = """WITH l AS (SELECT l_orderkey AS thread, 'x' || l_linenumber AS x, lower(l_returnflag) AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS again FROM lineitem),
b AS (SELECT thread, count(*) AS n, string_agg(CASE WHEN again = 1 THEN x END, ',' ORDER BY i) AS xs, string_agg('item(' || x || '), ' || f || '(' || x || ')', ', ' ORDER BY i) AS conds,
  repeat('(', (2 * count(*) - 1)::INTEGER) || string_agg(CASE WHEN i = 1 THEN 'item(' || x || ') & ' || f || '(' || x || '))' ELSE ' & item(' || x || ')) & ' || f || '(' || x || '))' END, '' ORDER BY i) AS body,
  string_agg(CASE WHEN again = 1 THEN 'exists ' || x || '.' END, '' ORDER BY i) AS heads FROM l GROUP BY thread)
SELECT thread, n, '([' || xs || '],[' || conds || '])' AS merged, heads || body AS fol FROM b"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer about each region's nations."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("([x"), "n_nationkey", F.lit("],[nation(x"), "n_nationkey", F.lit(")])")))).alias("d"))
    return n.select("n_regionkey", arrow.discourse_answer(F.col("d"), "([z],[nation(z), large(z)])", {"nation": [["a"], ["b"]], "large": [["b"]]}, ["a", "b"]).alias("answer"))


def _proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a customer's segment follows from a rule about its nation."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey") % 5).alias("n"))
    facts = F.array(F.concat(F.lit("lives("), "n", F.lit(")")), F.lit("lives(n1) -> near(n1)"), F.lit("lives(n2) -> (near(n2) | far(n2))"), F.lit("-far(n2)"))
    goal = F.concat(F.lit("near("), "n", F.lit(")"))
    return c.select("c_custkey", arrow.proved(goal, facts).alias("tableau"), arrow.proved(goal, facts, "resolution").alias("resolution"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("buys(c"), "o_custkey", F.lit(")")).alias("fact")).distinct()


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("buys(c"), "c_custkey", F.lit(")")).alias("fact"))


_BUYS = "f AS (SELECT DISTINCT 'buys(c' || o_custkey || ')' AS fact FROM orders), a AS (SELECT 'buys(c' || c_custkey || ')' AS fact FROM customer)"
RULES = [("bird", "flies", "flies", "r1"), ("flies", "light", "light", "r2"), ("penguin", "swims", "swims", "r3")]


def _extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows by default for each part, by its size."""
    facts = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("bird"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("bird"), F.lit("~flies"), F.lit("penguin"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(arrow.default_extensions(facts, RULES), ",").alias("known"))


def _default_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(a, b, c) for a, b, c, _ in RULES], "prerequisite string, justification string, consequent string")
    facts = spark.createDataFrame([("bird",), ("penguin",), ("~swims",)], "fact string")
    return inference.default_step(facts, rules)


CATALOG = {
    "tree_leaves": (_leaves, f"WITH {_STATES} SELECT tree_id, array_to_string(w, ' ') AS leaves, len(w)::BIGINT AS n FROM w"),
    "tree_heights": (_heights, f"WITH {_STATES} SELECT tree_id, len(w) + 1 AS height FROM w"),
    "tree_productions": (_productions, None),
    "tree_subtrees": (_subtrees, f"WITH {_STATES}, i AS (SELECT tree_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) SELECT tree_id, (CASE WHEN i = len(w) THEN 3 * i - 3 ELSE 3 * i - 2 END)::INTEGER AS node, '(P ' || w[i] || ')' AS subtree FROM i"),
    "chunk_trees": (_chunk_trees, None),
    "ccg_parse": (_ccg, f"WITH w AS (SELECT p_partkey AS sent_id, string_split(lower(p_name), ' ') AS w FROM part) SELECT sent_id, CASE WHEN w[1] NOT IN {_ADJECTIVES} THEN 'No parse found' WHEN w[2] IN {_ADJECTIVES} THEN 'Derivation 1: N/N (rule: FC)' ELSE 'Derivation 1: N (rule: FA)' END AS derivations FROM w WHERE len(w) = 2"),
    "ccg_lookup": (_ccg_lookup, "SELECT DISTINCT word, category FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) JOIN (VALUES ('cold', 'N/N'), ('small', 'N/N'), ('large', 'N/N'), ('hot', 'N/N'), ('widget', 'N'), ('bolt', 'N'), ('bolt', 'NP')) l(word, category) USING (word)"),
    "formulas": (_simplified, f"SELECT c_custkey, formula, simple, 'rich,' || lower_ AS free FROM (SELECT c_custkey, formula, simple, split_part(free, ',', 2) AS lower_ FROM ({_FORMULAS}))"),
    "formula_holds": (_holds, "SELECT o_custkey, bool_and(o_orderstatus = 'F') AS every, bool_or(o_orderstatus = 'F') AS some FROM orders GROUP BY o_custkey"),
    "discourse_threads": (_threads, _THREADS),
    "discourse_answers": (_answers, "SELECT DISTINCT n_regionkey, 'true' AS answer FROM nation"),
    "proofs": (_proofs, "SELECT c_custkey, c_nationkey % 5 IN (1, 2) AS tableau, c_nationkey % 5 IN (1, 2) AS resolution FROM customer"),
    "closed_world": (lambda s, d: inference.closed_world(_facts(s, d), _atoms(s, d)), f"WITH {_BUYS} SELECT fact, fact IN (SELECT fact FROM f) AS holds FROM a"),
    "negative_facts": (lambda s, d: inference.negative_facts(_facts(s, d), _atoms(s, d)), f"WITH {_BUYS} SELECT '~' || fact AS fact FROM a WHERE fact NOT IN (SELECT fact FROM f)"),
    "default_extensions": (_extensions, "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'bird,flies,light' WHEN 1 THEN 'bird,penguin,swims,~flies' ELSE '' END AS known FROM part"),
    "default_step": (_default_step, "SELECT unnest(['bird', 'penguin', '~swims', 'flies']) AS fact"),
}
