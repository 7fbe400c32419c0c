"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The jobs follow the life of a database: sketch and store it, index it, query it. Queries use the
stored database and index, as they would in production.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from sketchloom.operators import blocks, cluster, maintenance, membership, multik, sketch, superkmers
from sketchloom.operators.sketch import SketchSpec
from sketchloom.plans import tables as t
from sketchloom.session import get_spark, materialize, scratch_dir
from sketchloom.sources.sketchdb import export_database, import_database


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    kept: dict[str, object] = {}
    place = os.path.join(scratch_dir(spark), f"bench-{uuid.uuid4().hex}")
    spec = SketchSpec(n=500, ksize=21)

    def run(name, job):
        start = time.time()
        kept[name] = job()
        times[name] = round(time.time() - start, 3)

    def rows(frame) -> int:
        frame.write.format("noop").mode("overwrite").save()
        return 1

    docs = t.documents(spark, folder, dna=True)
    sample = t.benchmark(spark, folder, dna=True)
    run("train_database", lambda: export_database(maintenance.build(docs, spec), f"{place}/db"))
    db = import_database(spark, f"{place}/db")
    run("index_database", lambda: multik.prepare(db.entries, t.KS, t.K))
    index, lookup = kept["index_database"]
    run("multi_k_matches", lambda: materialize(multik.matches(sample, index, lookup, t.KS), "matches"))
    run("multi_k_containment", lambda: rows(multik.wide(multik.containment(kept["multi_k_matches"], db.entries, t.KS), t.KS)))
    run(
        "membership",
        lambda: rows(membership.query_membership(db.meta, db.entries, sample, spec, strand_neutral=True)),
    )
    run("ground_truth", lambda: rows(superkmers.containment(docs, sample, [t.K])))
    run("db_info", lambda: maintenance.info(db.meta).first())
    run("db_delete", lambda: rows(maintenance.delete(db, t.table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("name"))).entries))
    run("sketch_copies", lambda: rows(blocks.distinct_sketches(sketch.down_sample(db.entries, 200))))
    run("cluster", lambda: rows(cluster.cluster_sketches(sketch.down_sample(db.entries, 200), 200, 0.05)))
    print(
        json.dumps(
            {
                "metric": "sketch_query_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
