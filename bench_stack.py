"""Times gridding, unwrapping and the way back for a stack of the size of the published figure:
77,850 points, 76 interferograms, cells of 200 m. The stack is made by Spark in the run, smooth
deformation plus noise; nothing is read.  python bench_stack.py [points] [interferograms]
"""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, HERE)


def main(points: int = 77_850, dates: int = 76, extent: float = 26_000.0) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from scatterlake.operators import grid, unwrap

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    unit = lambda seed: F.pmod(F.xxhash64("ps_id", F.lit(seed)), F.lit(1_000_000)) / 1e6
    p = spark.range(points).select(F.col("id").alias("ps_id"), F.lit(1).alias("patch_id")).withColumns({"x": unit(1) * extent, "y": unit(2) * extent})
    noise = (F.pmod(F.xxhash64("ps_id", "ifg_ix"), F.lit(1_000_000)) / 1e6 - 0.5) * 3.0
    angle = F.sin(F.col("x") / 3000 + F.col("ifg_ix") / 9) * 6 + F.col("y") / 2500 * F.col("ifg_ix") / 20 + noise
    phase = p.withColumn("ifg_ix", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(dates).cast("long")))).withColumn("a", angle).select("ps_id", "ifg_ix", F.cos("a").alias("re"), F.sin("a").alias("im"))
    began = time.time()
    placed = grid.cells(p, 200.0, 1e-3)
    cells = grid.accumulate(phase, placed).select("patch_id", "gi", "gj", "ifg_ix", F.atan2("im", "re").alias("ph"))
    back = grid.restore(phase, placed, unwrap.unwrap(cells))
    back.write.format("noop").mode("overwrite").save()
    print(json.dumps({"metric": "stack_unwrap", "value": round(time.time() - began, 2), "unit": "sec", "points": points, "interferograms": dates, "cpus": int(cpus)}))


if __name__ == "__main__":
    main(*map(int, sys.argv[1:3]))
