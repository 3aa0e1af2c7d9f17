"""Command line: init, run, info, supertree, consensus, concordance."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import functions as F

from .operators import concordance, consensus, trees
from .operators.encode import matrix_summary, zero_based
from .operators.quartets import budget
from .operators.supertree import named
from .operators.treeindex import TreeIndex
from .plans import inference
from .session import session
from .sources import files


log = logging.getLogger("cladeweave")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cladeweave", description="Species trees from SNP quartets.")
    p.add_argument("--log-level", help="of Spark and of this program, such as INFO or ERROR")
    sub = p.add_subparsers(dest="command", required=True)
    told = argparse.ArgumentParser(add_help=False)
    told.add_argument("--log-level", default=argparse.SUPPRESS, help="as before the command")
    init = sub.add_parser("init", help="start a project from a SNP matrix (Parquet folder, .vcf or .hdf5)", parents=[told])
    init.add_argument("data")
    init.add_argument("-n", "--name", default="project")
    init.add_argument("-w", "--workdir", default=".")
    init.add_argument("-q", "--nquartets", type=int, default=0)
    init.add_argument("-r", "--random-seed", type=int, default=0)
    init.add_argument("-x", "--weights", type=int, default=1)
    init.add_argument("-s", "--subsample-snps", action="store_true")
    init.add_argument("-l", "--linkage-block", type=int, default=0, help="sites of one block of this length are linked (VCF)")
    init.add_argument("--one-based", action="store_true", help="loci of a Parquet matrix count from 1")
    run = sub.add_parser("run", help="score quartets of the data and of bootstrap replicates", parents=[told])
    run.add_argument("json")
    run.add_argument("-c", "--cores", type=int, default=0)
    run.add_argument("-b", "--nboots", type=int, default=0)
    run.add_argument("-f", "--force", action="store_true", help="score replicates anew that are there")
    run.add_argument("--refine", action="store_true", help="improve trees by local search on the quartets")
    run.add_argument("--save-counts", action="store_true", help="keep the site patterns' counts")
    info = sub.add_parser("info", help="show a project", parents=[told])
    info.add_argument("json")
    info.add_argument("-s", "--samples", action="store_true")
    for name, text in (("supertree", "trees of replicates"), ("consensus", "consensus of replicates"), ("concordance", "concordance with a tree")):
        q = sub.add_parser(name, help=text, parents=[told])
        q.add_argument("json")
        q.add_argument("-w", "--weights", type=int, default=1)
        q.add_argument("-s", "--min-snps", type=int, default=0)
        q.add_argument("-r", "--min-ratio", type=float, default=1.0)
        q.add_argument("-o", "--outgroup")
        if name != "concordance":
            q.add_argument("--refine", action="store_true", help="improve trees by local search on the quartets")
        if name == "supertree":
            q.add_argument("-i", "--idx", type=int, help="one replicate; all without it")
        else:
            q.add_argument("-t", "--tree", required=name == "concordance", help="newick file")
            q.add_argument("-c", "--cores", type=int, default=4)
        if name == "concordance":
            q.add_argument("--need-data", action="store_true", help="quartets without sites are uninformative")
    return p


def _matrix(spark, path: str, block: int, one_based: bool):
    """snps and samples of an input path."""
    if path.endswith((".vcf", ".vcf.gz")):
        cells, samples = files.read_vcf(spark, path, block)
        return files.numbered_sites(cells), samples
    if path.endswith((".hdf5", ".h5")):
        names = files.hdf5_names(path)
        return files.read_hdf5(spark, path), spark.createDataFrame(list(enumerate(names)), "sample_idx INT, name STRING")
    snps = files.read_matrix(spark, path)
    ids = snps.select("sample_idx").distinct()
    return (zero_based(snps) if one_based else snps), ids.select("sample_idx", F.col("sample_idx").cast("string").alias("name"))


def _finish(root: trees.Node, outgroup: str | None) -> str:
    return trees.write_newick(trees.rooted(root, outgroup) if outgroup else root, features=True)


def _init(args) -> None:
    spark = session()
    snps, samples = _matrix(spark, args.data, args.linkage_block, args.one_based)
    project = files.Project(args.name, args.data, args.workdir, args.weights, args.subsample_snps, args.nquartets, args.random_seed)
    snps.write.mode("overwrite").parquet(project.path("snps"))
    found = matrix_summary(spark.read.parquet(project.path("snps"))).first()
    project.samples = {r.sample_idx: r.name for r in samples.collect()}
    project.nsamples, project.nsnps = len(project.samples), found.n_sites
    sized = budget(project.nsamples, args.nquartets)
    project.nqrts, project.nqrts_total = sized["taken"], sized["total"]
    if sized["sparse"]:
        print(f"note: {sized['taken']} quartets are few for {project.nsamples} samples; {sized['rough']} or more cover them well", file=sys.stderr)
    project.save()
    print(project.path("json"))


def _run(args) -> None:
    spark = session(cores=args.cores)
    project = files.Project.load(args.json)
    snps = spark.read.parquet(project.path("snps"))
    kept = project.path("counts") if args.save_counts else None
    if args.force:
        for what in ("quartets", "quartets.manifest", "counts", "trees"):
            files.delete(spark, project.path(what))
    done = inference.run(snps, project.nsamples, project.path("quartets"), args.nboots, project.nquartets, project.random_seed, project.subsample_snps, counts_out=kept)
    quartets = files.read_quartets(spark, project.path("quartets"))
    rows = inference.replicate_trees(quartets, project.weights, refine=args.refine)
    rows.write.mode("overwrite").parquet(project.path("trees"))
    newicks = {r.rep: r.newick for r in spark.read.parquet(project.path("trees")).collect()}  # one row a replicate
    _write_trees(spark, project, newicks)
    log.info("%d trees", len(newicks))
    print(f"replicates scored: {done}")


def _write_trees(spark, project, newicks: dict[int, str]) -> None:
    """The best tree, the replicates' trees, and with replicates their consensus and the best tree's supports, as newick files."""
    if 0 in newicks:
        files.write_text(project.path("best.nwk"), [named(newicks[0], project.samples)])
    boots = [newicks[rep] for rep in sorted(newicks) if rep]
    files.write_text(project.path("boots.nwk"), [named(t, project.samples) for t in boots])
    if len(boots) < 2:
        return
    freqs = inference.replicate_split_frequencies(spark, boots)
    agreed = consensus.consensus_tree([(tuple(r.side), r.freq) for r in freqs.collect()], sorted(project.samples))
    files.write_text(project.path("cons.nwk"), [_finish(_named(agreed, project.samples), None)])
    if 0 in newicks:
        held = consensus.with_support(newicks[0], freqs, spark)
        files.write_text(project.path("supports.nwk"), [_finish(_named(held, project.samples), None)])


def _trees(spark, project, args, idx=None) -> list:
    quartets = files.read_quartets(spark, project.path("quartets"))
    if idx is not None:
        quartets = quartets.where(F.col("rep") == idx)
    return inference.replicate_trees(quartets, args.weights, args.min_snps, args.min_ratio, args.refine).orderBy("rep").collect()


def _supertree(args) -> None:
    project = files.Project.load(args.json)
    for row in _trees(session(), project, args, args.idx):
        print(_finish(trees.parse_newick(named(row.newick, project.samples)), args.outgroup))


def _indexed(text: str, samples: dict) -> trees.Node:
    return trees.relabel(trees.parse_newick(text), {v: k for k, v in samples.items()})


def _named(root: trees.Node, samples: dict) -> trees.Node:
    return trees.relabel(root, {str(k): v for k, v in samples.items()})


def _consensus(args) -> None:
    spark, project = session(cores=args.cores), files.Project.load(args.json)
    newicks = [r.newick for r in _trees(spark, project, args)]
    freqs = inference.replicate_split_frequencies(spark, newicks)
    if args.tree:
        own = _indexed(open(args.tree).read(), project.samples)
        root = consensus.with_support(trees.write_newick(own), freqs, spark)
    else:
        root = consensus.consensus_tree([(tuple(r.side), r.freq) for r in freqs.collect()], sorted(project.samples))
    print(_finish(_named(root, project.samples), args.outgroup))


def _concordance(args) -> None:
    spark, project = session(cores=args.cores), files.Project.load(args.json)
    root = _indexed(open(args.tree).read(), project.samples)
    own = trees.splits(root)
    order = trees.edge_order(own)
    quartets = files.read_quartets(spark, project.path("quartets"))
    edges, tips = concordance.concordance(quartets, TreeIndex(root), args.min_snps, args.min_ratio, args.need_data)
    shown = lambda x: round(x, 6) if isinstance(x, float) else x
    log.info("features: %s", ", ".join(concordance.features_added([k for n in root.nodes() for k in n.features], [*edges.columns[1:], "qf"])))
    for row in edges.collect():  # one row an edge
        own[order[row.edge_id]].features.update({k: shown(v) for k, v in row.asDict().items() if k != "edge_id" and v is not None})
    fidelity = {str(r.sample_idx): r.qf for r in tips.collect()}
    for node in root.nodes():
        if not node.children and fidelity.get(str(node.name)) is not None:
            node.features["qf"] = shown(fidelity[str(node.name)])
    print(_finish(_named(root, project.samples), args.outgroup))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level or "WARNING", format="%(asctime)s %(levelname)s %(message)s")
    log.setLevel(args.log_level or "WARNING")
    if args.log_level:
        session(log_level=args.log_level)
    if args.command == "info":
        project = files.Project.load(args.json)
        for k, v in files.project_info(session(), project, args.samples).first().asDict().items():
            print(f"{k}: {v}")
    else:
        {"init": _init, "run": _run, "supertree": _supertree, "consensus": _consensus, "concordance": _concordance}[args.command](args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
