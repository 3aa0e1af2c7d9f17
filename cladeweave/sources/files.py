"""Files the engine reads and writes: matrices, quartet tables, population maps, projects."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..operators.quartets import NAMES
from .datasources import file_system, is_blocked, register

QUARTETS = "i0 INT, i1 INT, i2 INT, i3 INT, s0 DOUBLE, s1 DOUBLE, s2 DOUBLE, res INT, nsnps BIGINT"


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """sample_idx, locus, site, base from Parquet."""
    return spark.read.parquet(path).select("sample_idx", "locus", "site", "base")


def read_hdf5(spark: SparkSession, path: str, columns: int = 4096) -> DataFrame:
    """A SNP file with /snps (samples x sites) and /snpsmap (locus from 1 in its first column), by tasks of whole chunks; needs h5py."""
    register(spark)
    return spark.read.format("snps_hdf5").option("path", path).option("columns", columns).load()


def hdf5_names(path: str) -> list[str]:
    import h5py

    system, inner = file_system(path)
    with system.open_input_file(inner) as file, h5py.File(file, "r") as f:
        return [x.decode() if isinstance(x, bytes) else str(x) for x in f["snps"].attrs["names"]]


def text_lines(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """value: the lines of text files. Block-gzipped ones are read by many tasks, each from a block on; other gzip files have no place to begin at but the first."""
    if path.endswith((".gz", ".bgz")) and is_blocked(path):
        register(spark)
        reader = spark.read.format("blocked_lines").option("path", path)
        return (reader.option("split", split) if split else reader).load()
    return spark.read.text(path)


def read_vcf(spark: SparkSession, path: str, block: int = 0, split: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sample_idx, chrom, block, pos, ref, alt, copy, base), samples from a VCF of single bases.

    Two different called alleles become their two-base code; anything else is missing.
    The locus is the chromosome, or with block the part of it of that length. A record is
    a site: several at one position differ in ref or alt, and copy numbers equal ones.
    """
    lines = text_lines(spark, path, split)
    head = lines.where(F.col("value").startswith("#CHROM")).first().value.split("\t")[9:]
    samples = spark.createDataFrame(list(enumerate(head)), "sample_idx INT, name STRING")
    fields = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(fields.alias("f"), F.xxhash64("value").alias("line"))
    rows = rows.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"), "f", "line")
    part = F.expr(f"pos div {block}") if block else F.lit(0)
    same = Window.partitionBy("chrom", "pos", "ref", "alt").orderBy("line")  # the records of one position
    rows = rows.withColumn("block", part.cast("long")).withColumn("copy", F.row_number().over(same))
    alleles = F.concat(F.array(F.col("ref")), F.split("alt", ","))
    cells = rows.select(*SITE, alleles.alias("alleles"), F.posexplode(F.slice("f", 10, len(head))).alias("sample_idx", "cell"))
    calls = F.split(F.substring_index("cell", ":", 1), "[/|]")
    called = F.array_sort(F.array_distinct(F.transform(calls, lambda c: F.get("alleles", c.try_cast("int")))))
    codes = {"A": 65, "C": 67, "G": 71, "T": 84, "AG": 82, "GT": 75, "CG": 83, "CT": 89, "AT": 87, "AC": 77}
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.array_join(called, "")), F.lit(78))
    whole = ~F.exists(F.transform(calls, lambda c: F.get("alleles", c.try_cast("int"))), lambda x: x.isNull())
    return cells.select("sample_idx", *SITE, F.when(whole, base).otherwise(78).alias("base")), samples


#: What makes a record of a VCF, in the order of sites.
SITE = ["chrom", "block", "pos", "ref", "alt", "copy"]


def numbered_sites(vcf: DataFrame) -> DataFrame:
    """sample_idx, locus, site, base: loci and sites numbered in order of chromosome, block, position and record.

    Numbers come from prefix sums over bins of positions (of blocks for loci), so no
    window holds a chromosome.
    """
    records = vcf.select(*SITE).distinct()
    sites = numbered(records, "site", {"_chrom": F.col("chrom"), "_block": F.col("block"), "_bin": F.expr("pos div 16384")}, "pos", "ref", "alt", "copy")
    loci = numbered(records.select("chrom", "block").distinct(), "locus", {"_chrom": F.col("chrom"), "_bin": F.expr("block div 4096")}, "block")
    placed = sites.join(loci, ["chrom", "block"]).select(*SITE, F.col("locus").cast("long").alias("locus"), F.col("site").cast("long").alias("site"))
    return vcf.join(placed, SITE).select("sample_idx", "locus", "site", "base")


def vcf_lines(snps: DataFrame, names: list[str]) -> DataFrame:
    """value: a matrix as the lines of a VCF, header included, in no order; samples it lacks at a site are missing calls."""
    called = {65: "0/0", 67: "1/1", 71: "2/2", 84: "3/3", 82: "0/2", 75: "2/3", 83: "1/2", 89: "1/3", 87: "0/3", 77: "0/1"}
    call = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in called.items() for x in kv]), F.col("base")), F.lit("./."))
    known = F.map_from_entries(F.collect_list(F.struct("sample_idx", call.alias("call"))))
    rows = snps.groupBy("locus", "site").agg(known.alias("m"))
    cells = [F.coalesce(F.element_at("m", i), F.lit("./.")) for i in range(len(names))]
    fixed = [F.format_string("c%012d", "locus"), (F.col("site") + 1).cast("string"), *map(F.lit, (".", "A", "C,G,T", ".", "PASS", ".", "GT"))]
    head = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    return snps.sparkSession.createDataFrame([(x,) for x in head], "value STRING").unionByName(rows.select(F.concat_ws("\t", *fixed, *cells).alias("value")))


def write_text(path: str, lines: list[str]) -> None:
    """A small text file of the driver, such as a tree for each line."""
    Path(path).write_text("".join(x + "\n" for x in lines))


def write_trees(trees: DataFrame, path: str) -> None:
    """rep, newick as text files of a tree a line, a folder for each replicate, in any file system that Spark reaches."""
    trees.select("rep", "newick").write.mode("overwrite").partitionBy("rep").text(path)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """rep, newick of write_trees()."""
    return spark.read.schema("value STRING, rep BIGINT").text(path).select("rep", F.col("value").alias("newick"))


def write_quartets(quartets: DataFrame, path: str, rep: int) -> None:
    """One replicate's rows as Parquet in its own folder, in place of what is there."""
    quartets.write.mode("overwrite").parquet(f"{path}/rep={rep}")


MANIFEST = "rep BIGINT, n BIGINT, checksum STRING"


def _told() -> Column:
    """What a row adds to the checksum of its replicate, whatever the rows' order."""
    return F.xxhash64(*[c.split()[0] for c in QUARTETS.split(", ")]).cast("decimal(38,0)")


def _state(quartets: DataFrame) -> tuple[int, str]:
    """Number of rows and their checksum."""
    row = quartets.agg(F.count(F.lit(1)), F.sum(_told())).first()
    return row[0], str(row[1])


def commit(quartets: DataFrame, path: str, rep: int) -> None:
    """Write a replicate's scored quartets, then its manifest row: rows and checksum of what the files hold.

    The manifest is written last and each row of it in one job's commit, so a replicate
    whose driver or job died in between is not in it, whatever files it left.
    """
    spark = quartets.sparkSession
    write_quartets(quartets, path, rep)
    n, checksum = _state(spark.read.schema(QUARTETS).parquet(f"{path}/rep={rep}"))
    spark.createDataFrame([(rep, n, checksum)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}.manifest/rep={rep}")


def commit_all(quartets: DataFrame, path: str, reps: list[int]) -> None:
    """As commit, for the replicates `reps` at once (column rep); their manifest rows are written when all are there."""
    spark = quartets.sparkSession
    for rep in reps:  # what an earlier run left
        delete(spark, f"{path}/rep={rep}")
    quartets.hint("rebalance", "rep").write.mode("append").partitionBy("rep").parquet(path)
    held = spark.read.schema(QUARTETS + ", rep BIGINT").parquet(path).where(F.col("rep").isin(reps))
    states = {r.rep: (r.n, str(r.checksum)) for r in held.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.sum(_told()).alias("checksum")).collect()}  # one row a replicate
    rows = [(rep, *states.get(rep, (0, str(None)))) for rep in reps]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").partitionBy("rep").parquet(f"{path}.manifest")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def committed(spark: SparkSession, path: str) -> set[int]:
    """The replicates that a manifest row says are whole."""
    if not exists(spark, f"{path}.manifest"):
        return set()
    return {r.rep for r in spark.read.schema(MANIFEST).parquet(f"{path}.manifest").select("rep").collect()}  # one row a replicate


def damaged(spark: SparkSession, path: str) -> list[int]:
    """Committed replicates whose files no longer hold the rows and checksum of their manifest row."""
    found = spark.read.schema(QUARTETS + ", rep BIGINT").parquet(path).groupBy("rep").agg(F.count(F.lit(1)).alias("have"), F.sum(_told()).cast("string").alias("sum"))
    rows = spark.read.schema(MANIFEST).parquet(f"{path}.manifest").join(found, "rep", "left")
    return sorted(r.rep for r in rows.where("NOT (have <=> n AND sum <=> checksum) AND NOT (n = 0 AND have IS NULL)").select("rep").collect())


def read_quartets(spark: SparkSession, path: str) -> DataFrame:
    """Scored quartets of the committed replicates."""
    rows = spark.read.schema(QUARTETS + ", rep BIGINT").parquet(path)
    return rows.where(F.col("rep").isin(*sorted(committed(spark, path))))


def delete(spark: SparkSession, path: str) -> None:
    """A folder in any file system that Spark reaches, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_quartets_tsv(quartets: DataFrame, path: str) -> None:
    """Tab-separated without header, scores with six decimals."""
    s = [F.format_string("%.6f", c).alias(c) for c in ("s0", "s1", "s2")]
    quartets.select(*NAMES, *s, "res", "nsnps").write.mode("overwrite").csv(path, sep="\t", header=False)


def read_quartets_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUARTETS).csv(path, sep="\t", header=False)


def read_population_map(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    """pop, sample_idx from lines of a population and a sample name; names that don't exist raise."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("pop"), parts[1].alias("name"))
    unknown = [r.name for r in rows.join(samples, "name", "left_anti").limit(5).collect()]
    if unknown:
        raise ValueError(f"samples in the population map that the data lack: {unknown}")
    return rows.join(samples, "name").select("pop", "sample_idx")


@dataclass
class Project:
    """What an analysis is, and where its files are."""

    name: str
    data: str
    workdir: str = "."
    weights: int = 1
    subsample_snps: bool = False
    nquartets: int = 0
    random_seed: int = 0
    nsamples: int = 0
    nsnps: int = 0
    nqrts: int = 0
    nqrts_total: int = 0
    samples: dict[int, str] = field(default_factory=dict)

    def path(self, what: str) -> str:
        return str(Path(self.workdir) / f"{self.name}.{what}")

    def save(self) -> None:
        Path(self.workdir).mkdir(parents=True, exist_ok=True)
        Path(self.path("json")).write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def load(cls, path: str) -> "Project":
        raw = json.loads(Path(path).read_text())
        raw["samples"] = {int(k): v for k, v in raw["samples"].items()}
        return cls(**raw)


def project_info(spark: SparkSession, project: Project, samples: bool = False) -> DataFrame:
    """One row with the project's fields; sample names only on demand."""
    row = {k: str(v) for k, v in asdict(project).items() if samples or k != "samples"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} STRING" for k in row))
