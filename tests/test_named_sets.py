"""The plans by name, from files to saved sets."""

import os

import numpy as np
import pytest

from geocurate.plans import curation, named
from geocurate.sources import tables


def name_of(east, north, heading, pano):
    return f"@{east:.2f}@{north:.2f}@10@S@37.0@-122.0@{pano}@@{heading}@@@@2020@note@.jpg"


def touch(folder, *names):
    os.makedirs(folder, exist_ok=True)
    for name in names:
        with open(os.path.join(folder, name), "wb") as file:
            file.write(b"0")


@pytest.fixture
def load_model():
    def load():
        return lambda paths: np.array([[1.0, 0.01 * (sum(map(ord, p)) % 7)] for p in paths], np.float32)

    return load


@pytest.fixture
def raw(folder):
    near = [name_of(1000 + i % 3, 2000 + 100 * (i // 6), 10, f"p{i}") for i in range(24)]
    touch(f"{folder}/raw/sf_xl/processed/train/a", *near[:12])
    touch(f"{folder}/raw/sf_xl/processed/train/_b", *near[12:])
    for queries, database in (*named.VAL_SETS.values(), *named.TEST_SETS.values()):
        touch(f"{folder}/raw/{queries}", name_of(0, 0, 0, "q0"), name_of(500, 0, 0, "q1"))
        touch(f"{folder}/raw/{database}", name_of(10, 0, 0, "d0"), name_of(200, 0, 0, "d1"))
    return f"{folder}/raw"


def test_single_source_plan_reads_embeds_and_saves(spark, folder, raw, load_model):
    params = curation.CurationParams(supergroup_size=2, kmeans_iter=3, tau=0.3)
    named.build_train(spark, raw, f"{folder}/out", f"{folder}/store", "sf_xl_train", ["sf_xl"], load_model, params)
    saved = tables.load_train(spark, f"{folder}/out", "sf_xl_train")
    assert saved.count() == 24 and saved.select("supergroup_id", "place_id").distinct().count() == 4
    assert tables.load_embeddings(spark, f"{folder}/store", "sf_xl").count() == 24
    named.build_variants(spark, raw, f"{folder}/out", f"{folder}/store", load_model, ["raw_gps"])
    assert tables.load_embeddings(spark, f"{folder}/store", "sf_xl").count() == 24
    assert tables.load_train(spark, f"{folder}/out", "sf_xl_raw_gps").count() == 24


@pytest.mark.parametrize("name", ["svox_val", "sf_xl_test"])
def test_evaluation_sets(spark, folder, raw, name):
    matched = {r.image_path.rsplit("/", 1)[1]: r for r in named.build_eval(spark, raw, f"{folder}/out", name).collect()}
    assert len(matched) == 3  # a query without a match is left out
    saved = tables.load_eval(spark, f"{folder}/out", name)
    assert sorted(map(len, (r.matches for r in saved.collect()))) == [0, 0, 1]
    assert len(named.VAL_SETS) == 5 and len(named.TEST_SETS) == 7


def test_city_files_keep_their_prefix_and_path(spark, folder):
    head = "city_id,place_id,year,month,northdeg,lat,lon,panoid\n"
    os.makedirs(f"{folder}/raw/gsvcities/Dataframes")
    for city, line in (("Aa", ""), ("Bb", "Bb,7,2019,3,45,51.5,-0.0005,pano\n")):
        with open(f"{folder}/raw/gsvcities/Dataframes/{city}.csv", "w") as file:
            file.write(head + line)
    (row,) = named.read_source(spark, f"{folder}/raw", "gsvcities").collect()
    assert row.place_id == 100_007
    assert row.image_path == "gsvcities/Images/Bb/Bb_0000007_2019_03_045_51.5_-0.0005_pano.jpg"


def test_combined_plan_reads_four_sources_and_halves_two(spark, folder, raw, load_model, monkeypatch):
    """24 images of the single source, and three more sources of two or three places each."""
    monkeypatch.setattr(curation, "COMBINED", curation.replace(curation.COMBINED, tau=-1.0, min_images=1, kmeans_iter=5))
    os.makedirs(f"{folder}/raw/gsvcities/Dataframes")
    with open(f"{folder}/raw/gsvcities/Dataframes/Rome.csv", "w") as file:
        file.write("city_id,place_id,year,month,northdeg,lat,lon,panoid\n")
        file.writelines(f"Rome,{i // 2},2019,3,45,41.9{i},12.5,pano{i}\n" for i in range(4))
    touch(f"{folder}/raw/msls/train/x", *[name_of(9000 + 400 * (i // 2), 100, 10, f"m{i}") for i in range(8)])
    view = "@{}@7000@10@S@3@4@pano{}@{}@@@@@@pitch1_yaw1@.jpg"
    touch(f"{folder}/raw/pitts30k/images/train", *[view.format(5000 + 100 * (i // 3), i, i) for i in range(6)])
    named.build_combined(spark, raw, f"{folder}/out", f"{folder}/store", load_model)
    saved = tables.load_train(spark, f"{folder}/out", "gsvcities_sf_xl_pitts30k_msls_train").toPandas()
    keys = ["supergroup_id", "place_id"]
    count = {s: (len(g), len(g[keys].drop_duplicates())) for s, g in saved.groupby("source")}
    assert count == {"gsvcities": (4, 2), "sf_xl": (12, 2), "pitts30k": (6, 2), "msls": (4, 2)}
    assert sorted(saved.image_id) == list(range(26))
    for kind in ("summary", "supergroups", "sources", "analysis", "supergroup_quality", "supergroup_geo", "supergroup_histograms"):
        assert spark.read.json(f"{folder}/out/train/gsvcities_sf_xl_pitts30k_msls_train/{kind}").count() > 0
