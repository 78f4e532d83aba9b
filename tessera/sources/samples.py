"""Synthetic datasets, from seeds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.container import Dataset
from tessera.model import Table, as_category, circles, points, polygons_from_lists, raster, raster_from_array, table
from tessera.operators.aggregate import as_table, zonal_stats
from tessera.operators.raster import pyramid


def blobs(spark: SparkSession, length: int = 512, n_points: int = 200, n_shapes: int = 5, n_channels: int = 3, seed: int = 0) -> Dataset:
    """Images and labels (single and multiscale), points, circles, polygons, multipolygons, and a table on the labels."""
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, length, (max(6, length // 16), 2))
    y, x = np.mgrid[0:length, 0:length] + 0.5
    nearest = np.full((length, length), np.inf)
    owner = np.zeros((length, length), np.int64)
    for i, (cy, cx) in enumerate(centres, 1):
        d = (y - cy) ** 2 + (x - cx) ** 2
        owner = np.where(d < nearest, i, owner)
        nearest = np.minimum(nearest, d)
    labels = np.where(nearest < (length / 24) ** 2, owner, 0)
    image = np.stack([np.exp(-nearest / (length / (12 + 6 * c)) ** 2) + rng.normal(0, 0.01, (length, length)) for c in range(n_channels)])
    d = Dataset()
    d["blobs_image"] = raster_from_array(spark, image, ("c", "y", "x"))
    d["blobs_labels"] = raster_from_array(spark, labels, ("y", "x"))
    d["blobs_multiscale_image"] = pyramid(d["blobs_image"], [2, 2])
    d["blobs_multiscale_labels"] = pyramid(d["blobs_labels"], [2, 2])
    pts = pd.DataFrame({"id": np.arange(n_points), "x": rng.integers(0, length, n_points), "y": rng.integers(0, length, n_points), "genes": rng.choice(["gene_a", "gene_b"], n_points), "instance_id": rng.integers(1, len(centres) + 1, n_points)})
    d["blobs_points"] = points(as_category(spark.createDataFrame(pts), "genes", ["gene_a", "gene_b"]), feature_key="genes", instance_key="instance_id")
    at = rng.uniform(0.1 * length, 0.9 * length, (3, n_shapes, 2))
    r = rng.uniform(length / 40, length / 16, (3, n_shapes))
    d["blobs_circles"] = circles(spark.createDataFrame(pd.DataFrame({"id": np.arange(n_shapes), "x": at[0, :, 0], "y": at[0, :, 1], "radius": r[0]})))
    box = lambda c, s: [[(c[0] - s, c[1] - s), (c[0] + s, c[1] - s), (c[0] + s, c[1] + s), (c[0] - s, c[1] + s)]]
    d["blobs_polygons"] = polygons_from_lists(spark, [[box(c, s)] for c, s in zip(at[1], r[1])])
    d["blobs_multipolygons"] = polygons_from_lists(spark, [[box(c, s), box(c + 3 * s, s)] for c, s in zip(at[2], r[2])])
    d["table"] = as_table(zonal_stats(d["blobs_image"], d["blobs_labels"], ("sum",)), "blobs_labels", id_col="zone")
    return d


def annotation_for(spark: SparkSession, d: Dataset, name: str) -> Table:
    """A table with a numeric and a categorical column for each instance of an element."""
    from tessera.operators.relational import instances

    rows = instances(d.elements[name]).withColumn("obs_pos", F.xxhash64(F.col("instance_id").cast("string")))
    obs = rows.select("obs_pos", F.col("instance_id").cast("string").alias("obs_name"), F.lit(name).alias("region"), "instance_id", (F.pmod(F.xxhash64("instance_id"), F.lit(1000)) / 1000).alias("numerical"), F.when(F.pmod(F.xxhash64("instance_id", F.lit(1)), F.lit(2)) == 0, "a").otherwise("b").alias("categorical"))
    return table(obs, region=name, region_key="region", instance_key="instance_id")


def cluster_points(spark: SparkSession, length: int, per_cell: int) -> Dataset:
    """The benchmark's layout, generated in the JVM: an image and labels of ``length`` pixels a side, ``length`` cells as points, and ``length * per_cell`` transcripts."""
    n = length * per_cell
    df = spark.range(n).select("id", (F.rand(1) * length).alias("x"), (F.rand(2) * length).alias("y"), F.pmod("id", F.lit(100)).alias("gene"))
    cells = spark.range(length).select("id", (F.rand(3) * length).alias("x"), (F.rand(4) * length).alias("y"))
    obs = spark.range(length).select(F.col("id").alias("obs_pos"), F.col("id").cast("string").alias("obs_name"), F.lit("cells").alias("region"), F.col("id").alias("instance_id"))
    pixels = spark.range(length * length)
    at = {"y": F.floor(F.col("id") / length).cast("int"), "x": F.pmod("id", F.lit(length)).cast("int")}
    image = pixels.select(F.lit(0).alias("c"), *(v.alias(a) for a, v in at.items()), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("value"))
    labels = pixels.select(*(v.alias(a) for a, v in at.items()), F.floor(F.col("id") / length / 100).cast("long").alias("value"))
    size = {"y": length, "x": length}
    rasters = {"blobs_image": raster(image, ("c", "y", "x"), size, [0]), "blobs_labels": raster(labels, ("y", "x"), size)}
    return Dataset({**rasters, "transcripts": points(df), "cells": points(cells)}, {"table": table(obs, region="cells", region_key="region", instance_key="instance_id", check=False)})
