"""Readers of text formats, each a DataFrame read with checks that can fail the job.

Large files stay splittable where the format allows: records are found with a line
separator, never by reading a file whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True, comment: str | None = None, keep_na: bool = False) -> DataFrame:
    """Delimited text (gz as well) with an explicit schema; with keep_na, 'NA' and empty cells stay text."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header)
    if comment:
        reader = reader.option("comment", comment)
    if keep_na:
        return reader.option("nullValue", "\x00").option("emptyValue", "").csv(path).na.fill("")
    return reader.option("nullValue", "NA").csv(path)


def find_row(df: DataFrame, **equal: str):
    """The one row with these values."""
    for c, v in equal.items():
        df = df.where(F.col(c) == v)
    got = df.limit(2).collect()
    if len(got) != 1:
        raise ValueError(f"{'no row' if not got else 'more than one row'} with {equal}")
    return got[0]


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, description, sequence), sequences in upper case without line breaks."""
    # records begin where a line begins with '>'; the first one of a file keeps its mark
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^\\s*>", "").alias("value")).where(F.trim("value") != "")
    parts = F.split("value", "\r?\n", 2)
    head = F.trim(parts[0])
    return records.select(
        F.regexp_extract(head, r"^(\S+)", 1).alias("record_id"),
        F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"),
        F.upper(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s+", "")).alias("sequence"),
    )


def clean_residues(sequence: Column, allowed: str = "ABCDEFGHIKLMNPQRSTVWXYZ") -> Column:
    """Other letters become X; a stop at the end goes."""
    return F.regexp_replace(F.regexp_replace(sequence, r"\*$", ""), f"[^{allowed}]", "X")


def attributes(text: Column) -> Column:
    """The last column of a feature file as a map: key=value or key "value", parts separated by ';'; of a key that comes twice the last value counts."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p != "")
    key = lambda p: F.regexp_extract(p, r"^([^=\s]+)", 1)
    value = lambda p: F.regexp_replace(F.regexp_replace(p, r"^[^=\s]+\s*=?\s*", ""), '^"|"$', "")
    keys, values = F.reverse(F.transform(parts, key)), F.reverse(F.transform(parts, value))
    own = F.reverse(F.array_distinct(keys))
    return F.map_from_arrays(own, F.transform(own, lambda k: F.element_at(values, F.array_position(keys, k).cast("int"))))


def gff(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Feature rows (seqid, source, feature, start1, end1, score, strand, phase, attributes). strict: a row without nine fields fails the job."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    f = F.split("value", "\t", -1)
    if strict:
        lines = lines.where(F.when(F.size(f) == 9, True).otherwise(F.raise_error(F.concat(F.lit("not nine fields: "), "value")).cast("boolean")))
    else:
        lines = lines.where(F.size(f) == 9)
    return lines.select(f[0].alias("seqid"), f[1].alias("source"), f[2].alias("feature"), f[3].cast("long").alias("start1"), f[4].cast("long").alias("end1"), f[5].try_cast("double").alias("score"), f[6].alias("strand"), f[7].alias("phase"), attributes(f[8]).alias("attributes"))


def obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms (id, name, namespace, obsolete) and edges (node, parent, relation) by is_a and part_of."""
    stanzas = spark.read.option("lineSep", "\n\n").text(path).where(F.startswith(F.ltrim("value"), F.lit("[Term]")))
    one = lambda tag: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{tag}:[ ]*(.*)$", 1)), F.lit(""))
    terms = stanzas.select(one("id").alias("id"), one("name").alias("name"), one("namespace").alias("namespace"), F.coalesce(one("is_obsolete") == "true", F.lit(False)).alias("obsolete"), "value")
    edge = lambda relation, pattern: terms.where("NOT obsolete").select(F.col("id").alias("node"), F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("parent"), F.lit(relation).alias("relation"))
    edges = edge("is_a", r"(?m)^is_a:[ ]*(\S+)").union(edge("part_of", r"(?m)^relationship:[ ]*part_of[ ]+(\S+)"))
    return terms.drop("value"), edges


def annotations(spark: SparkSession, path: str, excluded_evidence: Sequence[str] = ()) -> DataFrame:
    """(gene_id, term, evidence) of an association file; rows with a NOT qualifier or excluded evidence are dropped."""
    f = F.split("value", "\t", -1)
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("!"))).where(F.size(f) >= 15)
    kept = rows.where(~F.array_contains(F.split(f[3], r"\|"), "NOT")).where(~f[6].isin(*excluded_evidence) if excluded_evidence else F.lit(True))
    return kept.select(f[1].alias("gene_id"), f[4].alias("term"), f[6].alias("evidence")).distinct()


def propagated(direct: DataFrame, closure: DataFrame) -> DataFrame:
    """(gene_id, term): each term with all its ancestors."""
    up = direct.join(closure.select(F.col("node").alias("term"), "ancestor"), "term").select("gene_id", F.col("ancestor").alias("term"))
    return direct.select("gene_id", "term").union(up).distinct()


def orthogroups(spark: SparkSession, path: str) -> DataFrame:
    """(orthogroup, species, gene_id) from lines 'OG: species|gene|... ...'."""
    p = F.split("value", r":\s*", 2)
    rows = spark.read.text(path).where(F.contains("value", F.lit(":"))).select(F.trim(p[0]).alias("orthogroup"), F.explode(F.split(F.trim(p[1]), r"\s+")).alias("member"))
    m = F.split("member", r"\|")
    return rows.where("member <> ''").select("orthogroup", m[0].alias("species"), F.get(m, F.lit(1)).alias("gene_id"))


def taxonomy(spark: SparkSession, names: str, nodes: str) -> tuple[DataFrame, DataFrame]:
    """Names (name, taxid) that mean one taxon among scientific names, synonyms and equivalent names, and edges (node, parent) without the root's own."""
    cut = lambda path: spark.read.text(path).select(F.split(F.trim("value"), r"\s*\|\s*").alias("f"))
    n = cut(names).where("f[3] IN ('scientific name', 'synonym', 'equivalent name')").select(F.col("f")[1].alias("name"), F.col("f")[0].cast("long").alias("taxid"))
    unique = n.groupBy("name").agg(F.min("taxid").alias("taxid"), F.count_distinct("taxid").alias("k")).where("k = 1").drop("k")
    return unique, cut(nodes).select(F.col("f")[0].cast("long").alias("node"), F.col("f")[1].cast("long").alias("parent")).where("node <> parent")


def soft(spark: SparkSession, path: str) -> DataFrame:
    """(entity, name, key, value) of a key-value block file: '^ENTITY = name' begins a block, '!key = value' belongs to it.

    Files are cut at blocks, so a large one is shared by many tasks; lines before the first block are left out.
    """
    blocks = spark.read.option("lineSep", "\n^").text(path).select(F.split(F.regexp_replace("value", r"^\^", ""), "\r?\n").alias("l"))
    lines = blocks.where(~F.col("l")[0].rlike("^\\s*([!#]|$)")).select(F.col("l")[0].alias("head"), F.explode(F.slice("l", 2, F.greatest(F.lit(0), F.size("l") - 1))).alias("line")).where(F.startswith("line", F.lit("!")))
    side = lambda c, i: F.trim(F.get(F.split(c, "=", 2), F.lit(i)))
    return lines.select(side("head", 0).alias("entity"), side("head", 1).alias("name"), F.regexp_replace(side("line", 0), "^!", "").alias("key"), side("line", 1).alias("value"))


def domain_table(spark: SparkSession, path: str) -> DataFrame:
    """Domain hits of a white-space table with a free last column; rows with coordinates out of order or beyond the sequence fail the job."""
    f = F.split(F.trim("value"), r"\s+", 23)
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    out = rows.select(
        f[0].alias("domain"), f[1].alias("accession"), f[3].alias("protein"), f[5].cast("long").alias("protein_length"), f[6].cast("double").alias("e_value"), f[7].cast("double").alias("score"),
        f[12].cast("double").alias("i_e_value"), f[17].cast("long").alias("start1"), f[18].cast("long").alias("end1"), F.get(f, F.lit(22)).alias("description"),
    )
    fine = (F.col("start1") >= 1) & (F.col("start1") <= F.col("end1")) & (F.col("end1") <= F.col("protein_length"))
    return out.where(F.when(F.coalesce(fine, F.lit(False)), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("bad coordinates:"), "protein", F.col("start1").cast("string"), F.col("end1").cast("string"))).cast("boolean")))


def motif_hits(spark: SparkSession, path: str) -> DataFrame:
    """Motif hits (motif_id, motif_alt_id, sequence_name, start, stop, strand, score, p_value, q_value, matched_sequence); the header may be commented."""
    f = F.split("value", "\t", -1)
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^#|^\s*$|^motif_id\t")).where(F.size(f) >= 10)
    return rows.select(f[0].alias("motif_id"), f[1].alias("motif_alt_id"), f[2].alias("sequence_name"), f[3].cast("long").alias("start"), f[4].cast("long").alias("stop"), f[5].alias("strand"), f[6].cast("double").alias("score"), f[7].cast("double").alias("p_value"), f[8].try_cast("double").alias("q_value"), f[9].alias("matched_sequence"))


def motif_blocks(spark: SparkSession, path: str, chunks: int) -> DataFrame:
    """(motif_id, chunk, text) of a motif file, blocks dealt to chunks in turn by their place."""
    blocks = spark.read.option("lineSep", "\nMOTIF ").text(path).select("value", F.monotonically_increasing_id().alias("line"))
    body = blocks.where("line > 0").select(F.regexp_extract("value", r"^(\S+)", 1).alias("motif_id"), F.concat(F.lit("MOTIF "), "value").alias("text"), "line")
    from weft.operators.ordered import row_numbers

    return row_numbers(body, [], ["line"], "k").select("motif_id", ((F.col("k") - 1) % chunks).cast("long").alias("chunk"), "text")


def species_map(spark: SparkSession, path: str) -> DataFrame:
    """(species_id, name) from lines 'id: name'."""
    p = F.split("value", ":", 2)
    return spark.read.text(path).where(F.contains("value", F.lit(":"))).select(F.trim(p[0]).alias("species_id"), F.trim(p[1]).alias("name"))


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, content) of whole files."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")


def shortest_name(found: DataFrame, group: str, path: str, *without: str) -> DataFrame:
    """(group, path): for each group the path with the shortest name, ties by name, of those without the markers."""
    fine = found
    for marker in without:
        fine = fine.where(~F.contains(F.lower(path), F.lit(marker.lower())))
    return fine.groupBy(group).agg(F.min_by(path, F.struct(F.length(path), path)).alias(path))


def training_history(spark: SparkSession, path: str) -> DataFrame:
    """(file, step, loss, eval_loss) from the log of training states in JSON."""
    states = spark.read.option("multiLine", True).schema("log_history array<struct<step:long,loss:double,eval_loss:double>>").json(path)
    return states.select(F.col("_metadata.file_path").alias("file"), F.explode("log_history").alias("h")).select("file", "h.step", "h.loss", "h.eval_loss")


def report_fields(spark: SparkSession, path: str, **patterns: str) -> DataFrame:
    """(file, name...) with the first capture of each pattern in each whole text report."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), *[F.nullif(F.regexp_extract("value", p, 1), F.lit("")).alias(n) for n, p in patterns.items()])


def newick_edges(trees: DataFrame, ident: str, newick: str) -> DataFrame:
    """(ident, node, parent, label, branch_length) of Newick trees, one text a row; nodes are numbered in order of appearance, the root is 0 with no parent."""
    kind = dict(trees.dtypes)[ident]

    def parse(text: str) -> list[tuple]:
        rows, stack, node, made = [[0, None, "", None]], [], 0, 1
        i, text = 0, text.strip().rstrip(";")
        while i < len(text):
            c = text[i]
            if c in "(,":
                if c == "(":
                    stack.append(node)
                rows.append([made, stack[-1], "", None])
                node, made, i = made, made + 1, i + 1
            elif c == ")":
                node, i = stack.pop(), i + 1
            elif c == "[":
                i = text.index("]", i) + 1
            else:
                j = i
                while j < len(text) and text[j] not in "(),[":
                    j += 1
                label, _, length = text[i:j].partition(":")
                rows[node][2] = label.strip().strip("'\"") or rows[node][2]
                rows[node][3] = float(length) if length.strip() else rows[node][3]
                i = j
        return [tuple(r) for r in rows]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(key, *row) for key, text in b.itertuples(index=False) for row in parse(text)], columns=[ident, "node", "parent", "label", "branch_length"]).astype({"parent": "Int64"})

    return trees.select(ident, newick).mapInPandas(each, f"`{ident}` {kind}, node long, parent long, label string, branch_length double")
