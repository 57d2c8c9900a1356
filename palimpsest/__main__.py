"""Export a store: ``python -m palimpsest STORE OUT [--markdown]``."""

import argparse

from pyspark.sql import SparkSession

from palimpsest.memory import Memory


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="palimpsest", description="Write a store's records as lines of text.")
    p.add_argument("store")
    p.add_argument("out")
    p.add_argument("--markdown", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("palimpsest export").getOrCreate()
    lines = Memory(spark, a.store).export(a.markdown)
    if a.markdown:
        lines.orderBy("id").select("bullet").write.text(a.out)
    else:
        lines.orderBy("user_id", "ts", "round_id", "fact_id").select("line").write.text(a.out)


if __name__ == "__main__":
    main()
