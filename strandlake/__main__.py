"""Command line: a live run or a simulation from TOML files.

    python -m strandlake --toml run.toml [--decisions decisions.toml] [--work URI] [--input FOLDER]
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .plans import config as cf
from .plans import update as up
from .sources import fastq
from .streaming import live


def settings_of(config: cf.Config) -> up.Settings:
    names = ("min_seq_len", "min_contig_len", "min_s1", "min_map_len", "temperature", "mu", "lowcov", "tetra", "filter_repeats")
    return up.Settings(**{n: getattr(config, n) for n in names})


def main(argv: list[str] | None = None) -> None:
    parser = cf.parser()
    parser.add_argument("--input", default=".", help="folder that a live run watches")
    args = parser.parse_args(argv)
    config = cf.load(args.toml, args.decisions)
    spark = SparkSession.builder.appName(f"strandlake {config.name}").getOrCreate()
    if config.sim_run:
        reads = fastq.read_any(spark, [config.fq])
        _, clocks = live.run_simulation(spark, reads, args.work, config.bsize, config.binit, config.maxb, settings_of(config))
        clocks.show()
    else:
        live.run_live(spark, args.input, args.work, settings_of(config), config.wait, warm_up_bases=config.data_wait * 1_000_000).awaitTermination()


if __name__ == "__main__":
    main()
