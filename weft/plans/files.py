"""Queries over readers and writers: the tables are written as files of a format, read back, and compared with what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.checkpoints import shared_folder
from weft.operators import graph, integrity
from weft.plans.registry import query, table
from weft.sources import matrices, readers, slices, writers


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, line: Column, between: str = "\n") -> str:
    path = _path(df.sparkSession, "lines")
    df.select(line.alias("value")).write.option("lineSep", between).text(path)
    return path


def _say(*parts: Column | str) -> Column:
    """Text of constants and columns; a string that begins with '$' names a column."""
    return F.concat(*[F.col(p[1:]).cast("string") if isinstance(p, str) and p[:1] == "$" else F.lit(p) if isinstance(p, str) else p for p in parts])


_C = "c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_acctbal"


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"), "c_acctbal")


@query("s3_k1_delimited", f"SELECT {_C} FROM customer")
def _(spark, d):
    path = _path(spark, "tsv")
    writers.write_delimited(_customers(spark, d), path, gzip=True)
    return readers.delimited(spark, path, "c_custkey long, c_name string, segment string, c_acctbal double")


@query("s4_columns_of_a_csv", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey <= 50")
def _(spark, d):
    path = _path(spark, "csv")
    writers.write_delimited(_customers(spark, d), path, sep=",")
    return readers.delimited(spark, path, "c_custkey long, c_name string, segment string, c_acctbal double", sep=",").select("c_custkey", "c_acctbal").where("c_custkey <= 50")


@query("s5_literal_na", f"SELECT c_custkey, coalesce(segment, 'NA') AS segment FROM (SELECT {_C} FROM customer)")
def _(spark, d):
    path = _path(spark, "tsv")
    writers.write_delimited(_customers(spark, d).select("c_custkey", "segment"), path)
    return readers.delimited(spark, path, "c_custkey long, segment string", keep_na=True)


@query("s6_comment_lines", "SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 <> 0")
def _(spark, d):
    p = table(spark, d, "part")
    path = _lines(p, _say(F.when(F.col("p_partkey") % 3 == 0, "#").otherwise(""), "$p_partkey", "\t", "$p_size"))
    return readers.delimited(spark, path, "p_partkey long, p_size long", header=False, comment="#").withColumn("p_size", F.col("p_size").cast("int"))


@query("s7_motif_hits", "SELECT 'm' || s_nationkey AS motif_id, s_name AS sequence_name, s_suppkey::BIGINT AS start, (s_suppkey + 5)::BIGINT AS stop, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 0.5 END AS q_value FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier")
    body = _say("m", "$s_nationkey", "\talt\t", "$s_name", "\t", "$s_suppkey", "\t", (F.col("s_suppkey") + 5).cast("string"), "\t+\t9.5\t1e-6\t", F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("0.5"), "\tCACGTG")
    path = _lines(s, F.concat(F.when(F.col("s_suppkey") % 5 == 0, "#motif_id\tmotif_alt_id\tsequence_name\n").otherwise(""), body))
    return readers.motif_hits(spark, path).select("motif_id", "sequence_name", "start", "stop", "q_value")


@query("s10_k5_fasta", "SELECT 'p' || p_partkey AS record_id, upper(regexp_replace(p_name || p_type || p_brand || p_name || p_type, '\\s', '', 'g')) AS sequence FROM part")
def _(spark, d):
    path = _path(spark, "fasta")
    whole = F.upper(F.regexp_replace(F.concat("p_name", "p_type", "p_brand", "p_name", "p_type"), r"\s", ""))
    writers.write_fasta(table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("record_id"), whole.alias("sequence")), path)
    return readers.fasta(spark, path).select("record_id", "sequence")


@query("s11_wanted_records", "SELECT 'p' || p_partkey AS record_id, regexp_replace(upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')), '[^ABCDEFGHIKLMNPQRSTVWXYZ]', 'X', 'g') AS sequence FROM part WHERE p_partkey % 10 = 0")
def _(spark, d):
    path = _path(spark, "fasta")
    p = table(spark, d, "part")
    writers.write_fasta(p.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("record_id"), F.concat(F.regexp_replace("p_type", "[^A-Za-z]", ""), F.lit("*")).alias("sequence")), path)
    wanted = p.where("p_partkey % 10 = 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("record_id"))
    return readers.fasta(spark, path).join(wanted, "record_id", "left_semi").select("record_id", readers.clean_residues(F.col("sequence")).alias("sequence"))


@query("s12_slices", "SELECT doc_id, s AS start, s + 40 AS end, substr(text, s + 1, 40) AS sequence FROM (SELECT doc_id, coalesce(text, '') AS text, unnest([0, doc_id % 50, length(coalesce(text, '')) // 2, length(coalesce(text, '')) - 20]) AS s FROM documents) WHERE s >= 0")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = _path(spark, "store")
    slices.write_store(docs, path, "doc_id", "text", parts=16)
    n = F.length("text")
    asked = docs.select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.col("doc_id") % 50, F.floor(n / 2), (n - 20).cast("long"))).alias("start")).where("start >= 0").withColumn("end", F.col("start") + 40)
    return slices.fetch(spark, path, asked, "doc_id")


@query("s13_s14_features", "SELECT n_name AS seqid, 'g' || s_suppkey AS id, s_suppkey::BIGINT AS start1, (s_suppkey + 90)::BIGINT AS end1, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'last of ' || s_name AS note FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    strand = F.when(F.col("s_suppkey") % 2 == 0, "+").otherwise("-")
    path = _lines(s, _say("# a remark\n", "$n_name", "\tmade\tgene\t", "$s_suppkey", "\t", (F.col("s_suppkey") + 90).cast("string"), "\t.\t", strand, "\t.\tID=g", "$s_suppkey", ";Note=first;Note=last of ", "$s_name"))
    return readers.gff(spark, path).select("seqid", F.col("attributes")["ID"].alias("id"), "start1", "end1", "strand", F.col("attributes")["Note"].alias("note"))


def _obo(spark, d):
    n = table(spark, d, "nation").select(_say("[Term]\nid: N", "$n_nationkey", "\nname: ", "$n_name", "\nnamespace: place\nis_a: R", "$n_regionkey", " ! region\n").alias("v"))
    r = table(spark, d, "region").select(_say("[Term]\nid: R", "$r_regionkey", "\nname: ", "$r_name", "\nrelationship: part_of W\n").alias("v"))
    w = table(spark, d, "region").limit(1).select(F.lit("[Term]\nid: W\nname: world\n").alias("v"))
    return readers.obo(spark, _lines(n.union(r).union(w), F.col("v"), "\n"))


@query("s15_ontology", "SELECT 'N' || n_nationkey AS node, 'R' || n_regionkey AS parent, 'is_a' AS relation FROM nation UNION ALL SELECT 'R' || r_regionkey, 'W', 'part_of' FROM region")
def _(spark, d):
    return _obo(spark, d)[1]


@query("s16_annotations", "WITH a AS (SELECT 's' || s_suppkey AS gene_id, s_nationkey FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0) SELECT gene_id, 'N' || s_nationkey AS term FROM a UNION SELECT gene_id, 'R' || n_regionkey FROM a JOIN nation ON s_nationkey = n_nationkey UNION SELECT gene_id, 'W' FROM a")
def _(spark, d):
    s = table(spark, d, "supplier")
    path = _lines(s, _say("!a remark\ndb\ts", "$s_suppkey", "\ts\t", F.when(F.col("s_suppkey") % 5 == 0, "NOT|part_of").otherwise(""), "\tN", "$s_nationkey", "\tref\t", F.when(F.col("s_suppkey") % 7 == 0, "IEA").otherwise("IDA"), "\tx" * 8))
    return readers.propagated(readers.annotations(spark, path, ["IEA"]), graph.ancestors(_obo(spark, d)[1].select("node", "parent")))


@query("s17_orthogroups", "SELECT 'OG' || s_nationkey AS orthogroup, 'sp' || s_suppkey % 3 AS species, s_name AS gene_id FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("sp"), F.col("s_suppkey") % 3, F.lit("|"), F.regexp_replace("s_name", " ", "_")))), " ").alias("m"))
    path = _lines(s, _say("OG", "$s_nationkey", ": ", "$m"))
    return readers.orthogroups(spark, path).withColumn("gene_id", F.regexp_replace("gene_id", "_", " "))


@query("s18_taxonomy", "WITH n AS (SELECT n_nationkey + 10 AS taxid, n_name AS name FROM nation UNION ALL SELECT n_nationkey + 10, 'also ' || n_name FROM nation UNION ALL SELECT n_nationkey + 10, 'part of ' || n_regionkey FROM nation) SELECT name, min(taxid)::BIGINT AS taxid FROM n GROUP BY name HAVING count(DISTINCT taxid) = 1")
def _(spark, d):
    n = table(spark, d, "nation").withColumn("t", F.col("n_nationkey") + 10)
    line = lambda name, kind: _say("$t", "\t|\t", *name, "\t|\t\t|\t", kind, "\t|")
    names = _lines(n, F.concat_ws("\n", line(("$n_name",), "scientific name"), line(("also ", "$n_name"), "synonym"), line(("part of ", "$n_regionkey"), "equivalent name"), line(("common ", "$n_name"), "common name")))
    nodes = _lines(n, _say("$t", "\t|\t1\t|\tspecies\t|"))
    return readers.taxonomy(spark, names, nodes)[0]


@query("s19_series", "SELECT 'SAMPLE' AS entity, s_name AS name, 'nation' AS key, s_nationkey::VARCHAR || ' = n' AS value FROM supplier UNION ALL SELECT 'SAMPLE', s_name, 'key', s_suppkey::VARCHAR FROM supplier")
def _(spark, d):
    return readers.soft(spark, _lines(table(spark, d, "supplier"), _say("^SAMPLE = ", "$s_name", "\n!nation = ", "$s_nationkey", " = n\n!key = ", "$s_suppkey")))


@query("s20_domain_table", "SELECT 'd' || s_nationkey AS domain, 'p' || s_suppkey AS protein, (s_suppkey + 1)::BIGINT AS start1, (s_suppkey + 20)::BIGINT AS end1, 'free text of ' || s_nationkey AS description FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier")
    path = _lines(s, _say("# remark\nd", "$s_nationkey", "  acc  100   p", "$s_suppkey", " - 900000 1e-5 50.1 0 1 1 1e-3 2e-4 40 0 1 9 ", (F.col("s_suppkey") + 1).cast("string"), " ", (F.col("s_suppkey") + 20).cast("string"), " 1 9 0.9 free text of ", "$s_nationkey"))
    return readers.domain_table(spark, path).select("domain", "protein", "start1", "end1", "description")


@query("s25_newick", "SELECT s_suppkey AS tree, 3::BIGINT AS leaves, 's' || s_nationkey AS first_leaf, round(s_nationkey + 1.75, 6) AS total FROM supplier")
def _(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", _say("((s", "$s_nationkey", ":", "$s_nationkey", ",b:0.5)0.9:0.25,c:1);").alias("newick"))
    e = readers.newick_edges(t, "s_suppkey", "newick")
    leaf = ~F.col("label").isin("", "0.9")
    return e.groupBy(F.col("s_suppkey").alias("tree")).agg(F.count_if(leaf).alias("leaves"), F.min_by("label", F.when(leaf, F.col("node"))).alias("first_leaf"), F.round(F.sum("branch_length"), 6).alias("total"))


@query("s29_species_map", "SELECT s_suppkey::VARCHAR AS species_id, s_name AS name FROM supplier")
def _(spark, d):
    return readers.species_map(spark, _lines(table(spark, d, "supplier"), _say("$s_suppkey", ": ", "$s_name")))


@query("k2_k3_parquet_with_manifest", "SELECT n_nationkey, n_name, true AS whole FROM nation")
def _(spark, d):
    path = _path(spark, "published")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    settings = {"settings": integrity.settings_fingerprint({"table": "nation"})}
    before = writers.reusable(spark, path, **settings)
    writers.write_with_manifest(n, path, ["n_nationkey", "n_name"], **settings)
    whole = not before and writers.reusable(spark, path, **settings) and not writers.reusable(spark, path, settings="other")
    return spark.read.parquet(f"{path}/data").withColumn("whole", F.lit(whole))


@query("s28_plain_copy", "SELECT s_name AS value FROM supplier")
def _(spark, d):
    packed, plain = _path(spark, "packed"), _path(spark, "plain")
    table(spark, d, "supplier").select("s_name").write.option("compression", "gzip").text(packed)
    writers.copy_lines(spark, packed, plain)
    return spark.read.text(plain)


@query("m4_i2_frozen_files", "SELECT 1::BIGINT AS files, 0::BIGINT AS mismatches, 1::BIGINT AS tampered")
def _(spark, d):
    path = _path(spark, "frozen")
    table(spark, d, "region").select("r_name").coalesce(1).write.text(path)
    seen = integrity.file_hashes(readers.files(spark, path, "part-*"))
    wrong = seen.withColumn("sha256", F.lit("0"))
    return seen.agg(F.count(F.lit(1)).alias("files")).crossJoin(integrity.freeze_mismatches(seen.select("path", "sha256"), seen).agg(F.count(F.lit(1)).alias("mismatches"))).crossJoin(integrity.freeze_mismatches(wrong.select("path", "sha256"), seen).agg(F.count(F.lit(1)).alias("tampered")))


@query("g4_rooted_tips", "SELECT s_suppkey AS tree, 'c' AS label, 1::BIGINT AS place, 0.5 AS above FROM supplier UNION ALL SELECT s_suppkey, 'e', 2, 4.0 FROM supplier UNION ALL SELECT s_suppkey, 's', 3, round(s_nationkey + 0.5, 6) FROM supplier UNION ALL SELECT s_suppkey, 'b', 4, 0.5 FROM supplier")
def _(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("tree"), _say("((s:", "$s_nationkey", ".5,b:0.5)0.9:0.25,(c:1,e:4)0.7:2);").alias("newick"))
    r = graph.rooted(readers.newick_edges(t, "tree", "newick"), "tree", "c")
    return graph.tip_order(r, "tree").join(r.select("tree", "label", F.round("branch_length", 6).alias("above")), ["tree", "label"])


@query("s24_training_history", "SELECT (10 * r_regionkey + 1)::BIGINT AS step, r_regionkey + 0.5 AS loss, NULL::DOUBLE AS eval_loss FROM region UNION ALL SELECT 10 * r_regionkey + 2, NULL, r_regionkey + 0.25 FROM region")
def _(spark, d):
    path = _path(spark, "states")
    state = _say('{"best": null,\n "log_history": [{"step": ', (F.col("r_regionkey") * 10 + 1).cast("string"), ', "loss": ', "$r_regionkey", '.5}, {"step": ', (F.col("r_regionkey") * 10 + 2).cast("string"), ', "eval_loss": ', "$r_regionkey", ".25}]}")
    table(spark, d, "region").select("r_regionkey", state.alias("value")).write.partitionBy("r_regionkey").text(path)  # one file each
    return readers.training_history(spark, path).select("step", "loss", "eval_loss")


@query("s27_shortest_names", "SELECT r_name AS region, 'run/' || r_name || '/model.json' AS path FROM region")
def _(spark, d):
    tails = F.explode(F.array(*map(F.lit, ("/model.json", "/model-000.json", "/old/m.json", "/x.tmp")))).alias("tail")
    found = table(spark, d, "region").select(F.col("r_name").alias("region"), tails).select("region", F.concat(F.lit("run/"), "region", "tail").alias("path"))
    return readers.shortest_name(found, "region", "path", "OLD", ".tmp")


@query("k6_matrix", "SELECT vec_id, embedding[1]::DOUBLE AS first, len(embedding)::BIGINT AS width FROM embeddings WHERE vec_id % 3 = 0")
def _(spark, d):
    path = _path(spark, "matrix")
    writers.write_with_manifest(table(spark, d, "embeddings").select("vec_id", "embedding"), path, ["vec_id"], dtype="float32")
    rows = spark.read.parquet(f"{path}/data").where("vec_id % 3 = 0")
    return rows.select("vec_id", F.col("embedding")[0].cast("double").alias("first"), F.size("embedding").cast("long").alias("width"))


@query("s22_matrix_rows", "SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[len(embedding)]::DOUBLE AS last, len(embedding)::BIGINT AS width FROM embeddings WHERE vec_id % 3 = 0")
def _(spark, d):
    path, e = _path(spark, "npy"), table(spark, d, "embeddings")
    matrices.write_matrix(e, path, "vec_id", "embedding")
    rows = matrices.read_saved(spark, path, "vec_id", e.where("vec_id % 3 = 0"))
    return rows.select("vec_id", F.col("vector")[0].cast("double").alias("first"), F.element_at("vector", -1).cast("double").alias("last"), F.size("vector").cast("long").alias("width"))


@query("k7_gate_file", "SELECT 'priced' AS name, bool_and(p_retailprice > 0) AS passed FROM part UNION ALL SELECT 'small', bool_and(p_size < 10) FROM part")
def _(spark, d):
    path = _path(spark, "gate")
    integrity.checks(table(spark, d, "part"), priced=F.bool_and(F.col("p_retailprice") > 0), small=F.bool_and(F.col("p_size") < 10)).coalesce(1).write.json(path)
    return spark.read.schema("name string, passed boolean").json(path)


@query("k8_report_table", "SELECT count(*)::BIGINT + 2 AS lines, true AS framed FROM nation")
def _(spark, d):
    text = writers.markdown_table(table(spark, d, "nation").select("n_nationkey", "n_name"))
    lines = spark.createDataFrame([(x,) for x in text.splitlines()], "line string")
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.bool_and(F.startswith("line", F.lit("| "))).alias("framed"))
