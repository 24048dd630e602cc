import csv
import json
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalith.operators import extractors as E
from modalith.operators import tables
from modalith.operators.extract import ExtractionError, NativeExtractor, RowFunction
from modalith.operators.transforms import Resizer, VideoTransform
from modalith.functions.columns import SizeMode
from modalith.functions.images import decode
from modalith.plans.dataset import Dataset
from modalith.plans.pipeline import CONTINUE, Pipeline
from modalith.sources import spec as S
from modalith.sources.datasource import TarShards
from modalith.sources.media import Fetcher
from modalith.streaming import shards as streaming
from tests.core.files import loose, picture, shard, sound, write


@pytest.fixture
def good(tmp_path):
    for n in range(12):
        shard(tmp_path / "set", n, {f"{n}_{k}.png": picture(k, 10 + n, 6) for k in range(3)})
    return S.shards_spec(str(tmp_path / "set"), image="image_name", text="caption")


def test_specs():
    s = S.shards_spec("/d", image="name", text="t", archive_ext=".tar")
    assert s.renames == {"name": "image_name", "t": "text"} and s.modalities == ["image", "text"] and s.required == ["name", "t"] and s.path_columns == {"image_path": "image"}
    assert S.files_spec("/d/x.parquet", video="v").table_ext == "parquet" and s["image"].final == "image_path"
    for bad in (lambda: S.files_spec("/d/x.csv"), lambda: S.shards_spec("/d/", image="i"), lambda: S.Stored("image", "column", "i"), lambda: S.Stored("smell", "file", "i"),
                lambda: S.DatasetSpec("files", "/d", (S.Stored("image", "file", "a"), S.Stored("image", "file", "b"))), lambda: S.DatasetSpec("files", "/d", (S.Stored("image", "sharded", "a"),))):
        with pytest.raises(ValueError):
            bad()


def test_read_shards(spark, good):
    d = Dataset.read(spark, good)
    assert d.columns == ["image_path", "text", "split_name"] and d.count() == 36
    rows = {(r["split_name"], r["image_path"].rsplit("/", 1)[1]) for r in d.df.collect()}
    assert ("11", "11_2.png") in rows
    assert {r["image_path"] for r in d.df.collect()} >= {f"{good.path}/0.tar/0_0.png"}
    assert d.summary()["rows"] == 36


def test_read_files_and_folders(spark, tmp_path):
    d = Dataset.read(spark, S.files_spec(loose(tmp_path, {"a.png": picture(1), "b.png": picture(2)}), image="image_path", text="caption"))
    assert all(os.path.exists(r["image_path"]) for r in d.df.collect()) and {r["text"] for r in d.df.collect()} == {"title, of a.png", "title, of b.png"}
    shard(tmp_path / "f", 0, {"x.png": picture(1)}, folders=True)
    f = Dataset.read(spark, S.sharded_files_spec(str(tmp_path / "f"), image="image_name"))
    assert f.columns == ["image_path", "split_name", "caption"] and os.path.exists(f.df.first()["image_path"])


def test_tables_that_differ(spark, tmp_path):
    shard(tmp_path, 0, {"a.png": b"x", "b.png": b"x"})
    shard(tmp_path, 1, {"c.png": b"x", "d.png": b"x"}, more=",7")
    spec = S.shards_spec(str(tmp_path), image="image_name", text="caption")
    with pytest.raises(ValueError):
        Dataset.read(spark, spec)
    d = Dataset.read(spark, spec, validate_columns=False)
    assert (d.count(), len(d.columns)) == (4, 4) and d.where("test is null").count() == 2
    r = d.validate(check=["image_name", "caption", "test"])
    assert [p.kind for ps in r.tables.values() for p in ps] == ["missed_columns"] and not r.structure


def test_unpaired_tables(spark, tmp_path):
    shard(tmp_path, 0, {"a.png": b"x"})
    write(tmp_path / "1.csv", "image_name\nz.png\n")
    spec = S.shards_spec(str(tmp_path), image="image_name")
    with pytest.raises(FileNotFoundError):
        Dataset.read(spark, spec)
    os.rename(tmp_path / "1.csv", tmp_path / "1.tar")
    with pytest.raises(FileNotFoundError):
        Dataset.read(spark, spec)
    with pytest.raises(ValueError, match="lacks"):
        os.remove(tmp_path / "1.tar")
        Dataset.read(spark, S.shards_spec(str(tmp_path), image="no_such"))


@pytest.mark.parametrize("folders", [False, True])
def test_validation(spark, tmp_path, folders):
    make = S.sharded_files_spec if folders else S.shards_spec
    spec = make(str(tmp_path), image="image_name", text="caption")
    shard(tmp_path, 0, {"a.png": b"1", "b.png": b"2"}, folders=folders)
    assert Dataset.read(spark, spec).validate().total == 0
    shard(tmp_path, 1, {"c.png": b"1"}, table=["c.png", "lost.png"], folders=folders)
    r = Dataset.read(spark, spec).validate()
    assert not r.structure and [(p.kind, p.value) for ps in r.tables.values() for p in ps] == [("missing_value", "lost.png")]
    shard(tmp_path, 2, {"extra.png": b"1"}, table=["gone.png"], folders=folders)
    shard(tmp_path, 3, {"a.png": b"1", "spare.png": b""}, table=["a.png", "a.png"], folders=folders)
    r = Dataset.read(spark, spec).validate()
    assert sorted(p.kind for p in r.structure) == ["is_not_key", "no_such_file"] and r.structure[-1].path.endswith("gone.png")
    assert sorted(p.kind for ps in r.tables.values() for p in ps) == ["duplicated_values", "missing_value", "missing_value"]
    assert "file_not_in_data" in {p.kind for p in Dataset.read(spark, spec).validate(extras=True).structure}
    assert not Dataset.read(spark, spec).validate(structure=False).structure and not Dataset.read(spark, spec).validate(metadata=False).tables


def test_validation_of_files(spark, tmp_path):
    spec = S.files_spec(loose(tmp_path, {"a.png": b"1"}), image="image_path", text="caption")
    assert Dataset.read(spark, spec).validate().total == 0
    with open(spec.path, "a") as f:
        f.write("imgs/a.png,again\n")
    r = Dataset.read(spark, spec).validate(check=["image_path", "other"])
    assert [p.kind for p in r.structure] == ["is_not_key"] and sorted(p.kind for p in r.tables[spec.path]) == ["duplicated_values", "missed_columns"]


def test_extraction_and_its_errors(spark, tmp_path):
    shard(tmp_path, 0, {"a.png": picture(1, 20, 10), "b.png": b"damaged", "c.png": picture(1, 20, 10, 4)}, table=["a.png", "b.png", "c.png", "lost.png"])
    spec = S.shards_spec(str(tmp_path), image="image_name", text="caption")
    d = Dataset.read(spark, spec)
    with pytest.raises(Exception, match="lost.png"):
        d.extract(E.ImageInfo()).df.collect()
    with pytest.raises(ExtractionError):
        d.extract(E.ImageInfo(), on_error="null")
    got = {r["image_path"][-5:]: r for r in d.extract(E.ImageInfo(), on_error="null", validate=False).df.collect()}
    assert len(got) == 4 and sum(bool(r["is_correct"]) for r in got.values()) == 2
    assert (got["a.png"]["width"], got["a.png"]["height"], got["a.png"]["channels"], got["a.png"]["error"]) == (20, 10, 3, None)
    assert got["b.png"]["is_correct"] is False and got["b.png"]["error"] and got["t.png"]["is_correct"] is None
    with pytest.raises(Exception, match="identify"):
        d.where("image_path like '%b.png'").extract(E.PerceptualHash()).df.collect()
    with pytest.raises(ValueError):
        d.extract(E.AudioInfo())
    with pytest.raises(ValueError):
        d.extract(E.ImageInfo(), on_error="perhaps")
    assert d.where("image_path like '%a.png'").extract(E.ImageInfo(), tasks=3).count() == 1
    twice = d.where("image_path like '%a.png'").extract(E.ImageInfo()).extract(E.ImageInfo())
    assert twice.columns.count("width") == 1


def test_native_image_info(spark, tmp_path):
    d = Dataset.read(spark, S.files_spec(loose(tmp_path, {"a.png": picture(1, 20, 10), "b.png": b"damaged"}), image="image_path", text="caption"))
    assert sorted((r["is_correct"], r["width"]) for r in E.image_info_native(d.df).collect()) == [(False, None), (True, 20)]


def test_audio_and_video(spark, tmp_path):
    write(tmp_path / "a.wav", sound(4000))
    write(tmp_path / "b.wav", b"RIFFnot a sound")
    write(tmp_path / "t.csv", "p\na.wav\nb.wav\n")
    got = Dataset.read(spark, S.files_spec(str(tmp_path / "t.csv"), audio="p")).extract(E.AudioInfo()).df.orderBy("audio_path").collect()
    assert (got[0]["is_correct"], got[0]["duration"], got[0]["sample_rate"], got[1]["is_correct"]) == (True, 0.5, 8000, False) and got[1]["error"]

    class Video:
        fps, duration, frames = 10.0, 2.0, 15

        def __init__(self, blob):
            self.blob = blob

        def read(self, i):
            return np.full((4, 6, 3), i, np.uint8)

    class Flow:
        def frames(self, blob):
            return len(blob)

        def read(self, blob, i):
            return i

        def flow(self, a, b):
            return np.full((2, 2, 2), float(b - a))

    def probe():
        def facts(blob):
            if not blob.startswith(b"RIFFnot"):
                raise OSError("no video")
            return 6, 4, 10.0, 2.0

        return facts

    v = Dataset.read(spark, S.files_spec(str(tmp_path / "t.csv"), video="p"))
    assert sorted((r["is_correct"], r["width"]) for r in v.extract(E.VideoInfo(probe)).df.collect()) == [(False, None), (True, 6)]
    frame = v.extract(E.FrameOf(E.ImageInfo(), lambda: Video)).df.first()
    assert (frame["width"], frame["height"]) == (6, 4)
    flow = v.extract(E.OpticalFlow("flow", Flow, step=5, passes=3)).df.orderBy("video_path").collect()
    assert flow[0]["flow"] == round(5 * 2**0.5, 3)
    out = tmp_path / "new"
    done = v.with_column("fps", F.lit(30.0)).transform_videos(VideoTransform(fps=25), str(out), run=lambda c: open(c[-2], "wb").write(b"new")).df.collect()
    assert {r["fps"] for r in done} == {25.0} and all(open(r["video_path"], "rb").read() == b"new" for r in done) and len(os.listdir(out)) == 2
    with pytest.raises(LookupError):
        E.nsfw("nobody")


class Model:
    def image(self, pictures):
        return [[float(p.mean()), 100.0] for p in pictures]

    def text(self, texts):
        return [[float(len(t)), 100.0] for t in texts]


def test_model_extractors(spark, good):
    d = Dataset.read(spark, good).where("split_name = '3'")
    E.register_backend("model", Model)
    got = d.extract(E.LabelScores("m", ["cat", "a dog"], "model")).extract(E.TextSimilarity("sim", "model")).extract(E.aesthetic(lambda: lambda ps: [p.shape[1] for p in ps]))
    got = got.extract(E.watermark("w", lambda: lambda ps: [1 for _ in ps])).extract(E.captioner("cap", "short", lambda: lambda b, prompt: [f"USER x assistant {prompt}. b. b</s>" for _ in b], after="assistant", once=True))
    r = got.df.first()
    assert {'m clip score "cat"', 'm clip score "a dog"', "sim", "aesthetic_score", "watermark_w", "caption cap prompt short"} <= set(got.columns)
    assert 0 < r['m clip score "cat"'] <= 1 and 0 < r["sim"] <= 1.000001 and r["aesthetic_score"] == 13.0 and r["watermark_w"] == 1 and r["caption cap prompt short"] == "" 
    boxes = d.extract(E.TextBoxes(lambda: lambda ps: [[[[1, 1], [3, 4]], [[9, 9], [-2, 99]]] for _ in ps])).extract(E.ReadText("r", lambda: lambda cs: [str(c.shape[:2]) for c in cs]))
    r = boxes.df.first()
    assert r["num_text_boxes"] == 2 and json.loads(r["OCR_r"]) == [[[[1, 1], [3, 4]], "(3, 2)"], [[[9, 9], [-2, 99]], ""]]


def test_row_and_native_functions(spark, good):
    class Length(RowFunction):
        inputs, outputs = ("text",), "n int, upper string"

        def row(self, values):
            return len(values["text"]), values["text"].upper()

    class Twice(NativeExtractor):
        outputs = "twice int"

        def expressions(self):
            return [F.col("n") * 2]

    r = Dataset.read(spark, good).extract(Length()).extract(Twice()).df.first()
    assert r["n"] == len(r["text"]) and r["upper"] == r["text"].upper() and r["twice"] == 2 * r["n"]


@pytest.mark.parametrize("folders,naming", [(False, "counter"), (True, "counter"), (False, "uuid")])
def test_write_and_write_again(spark, good, tmp_path, folders, naming):
    d = Dataset.read(spark, good).with_column("score", F.lit(5))
    out = str(tmp_path / "out")
    write_ = d.write_folders if folders else d.write_shards
    new = write_(out, max_files=10, columns=["score"], rename={"score": "points"}, naming=naming)
    assert new.count() == 36 and new.validate().total == 0 and set(new.columns) == {"image_path", "text", "split_name", "points"}
    assert [n for n in sorted(os.listdir(out)) if n.endswith("csv")] == ["0.csv", "1.csv", "2.csv", "3.csv"] and not [n for n in os.listdir(out) if n.startswith(".")]
    if naming == "counter":
        assert {r["image_path"].rsplit("/", 1)[1] for r in new.df.collect()} == {f"{i}.png" for i in range(36)}
    old = {r["text"]: Fetcher("tar")(r["image_path"]) for r in d.df.collect()}
    assert {r["text"]: Fetcher("tar")(r["image_path"]) for r in new.df.collect()} == old
    again = write_(out, max_files=10, columns=["score"], rename={"score": "points"}, naming=naming)
    assert again.count() == 72 and again.validate().total == 0
    with pytest.raises(KeyError):
        d.write_shards(out, columns=["nothing"])


def test_metadata_on_disk(spark, good):
    assert Dataset.read(spark, good).with_column("score", F.length("text")).update_columns(["score"]) == []
    d = Dataset.read(spark, good)
    assert "score" in d.columns and d.where("score = length(text)").count() == 36
    assert d.rename_columns({"score": "points"}) == [] and "points" in Dataset.read(spark, good).columns
    with pytest.raises(KeyError):
        d.rename_columns({"score": "x"})
    with pytest.raises(KeyError):
        d.rename_columns({"points": "caption"})
    with pytest.raises(ValueError):
        d.delete_columns(["image_name"])
    with pytest.raises(ValueError):
        Dataset.read(spark, good).where("text not like '%_1%'").with_column("z", F.lit(1)).update_columns(["z"])
    assert Dataset.read(spark, good).delete_columns(["points"]) == [] and Dataset.read(spark, good).columns == ["image_path", "text", "split_name"]
    assert Dataset.read(spark, good).validate().total == 0


def test_metadata_of_files(spark, tmp_path):
    spec = S.files_spec(loose(tmp_path, {"a.png": b"1", "b.png": b"2"}), image="image_path", text="caption")
    assert Dataset.read(spark, spec).with_column("n", F.lit(3)).update_columns(["n"]) == []
    with open(spec.path) as f:
        rows = list(csv.DictReader(f))
    assert {r["image_path"] for r in rows} == {"imgs/a.png", "imgs/b.png"} and {r["n"] for r in rows} == {"3"} and "title, of a.png" in {r["caption"] for r in rows}


def test_dedup_order_and_split(spark, good):
    d = Dataset.read(spark, good).extract(E.PerceptualHash())
    one = d.with_column("k", F.lit(None).cast("string")).keep_first(["k"]).df.collect()
    assert len(one) == 1 and one[0]["image_path"].endswith("0.tar/0_0.png")
    by_shard = d.with_column("k", F.substring_index("text", "_", -1)).keep_first(["k"]).df.collect()
    assert sorted(r["split_name"] for r in by_shard) == ["0", "0", "0"]  # 2 comes before 10
    df = spark.range(101).repartition(7)
    assert [r["index"] for r in tables.dense_index(df, [F.col("id").desc()]).orderBy(F.col("id").desc()).collect()] == list(range(101))
    for parts in (1, 7, 101, 150):
        got = [r["part"] for r in tables.even_split(df, parts, [F.col("id")]).orderBy("id").collect()]
        assert got == [i for i, a in enumerate(np.array_split(range(101), parts)) for _ in a]
    assert tables.dense_index(df.limit(0), [F.col("id")]).count() == 0
    many = spark.range(40_000).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("x"), 9).alias("other")).repartition(9)
    assert [r["index"] for r in tables.dense_index(many, [F.col("k")]).orderBy("k").select("index").collect()] == list(range(40_000))


def test_merging(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "new"), (None, "null")], "k int, v string")
    assert sorted(map(tuple, tables.merge_back(a, b, "k").collect()), key=str) == sorted([(1, "new"), (None, "null"), (3, None)], key=str)
    with pytest.raises(ValueError):
        tables.merge_back(a, b.unionAll(b), "k")
    assert tables.missing_from(a, b, "k").count() == 2  # null is in no set
    assert sorted(r["copies"] for r in tables.repeated_values(a.unionAll(a), "k").collect()) == [2, 2, 2]
    assert tables.estimated_bytes(a) > 0 and tables.small(a, 0) is a


def test_pipeline(spark, tmp_path):
    shard(tmp_path, 0, {"a.png": picture(1), "b.png": picture(1)})
    shard(tmp_path, 1, {"c.png": b"bad"})
    spec = S.shards_spec(str(tmp_path), image="image_name", text="caption")
    d = Dataset.read(spark, spec)
    p = Pipeline("ok", counts=True).extract(E.ImageInfo).dataframe(lambda df: df.where("is_correct")).extract(E.PerceptualHash, {"size": 8}).deduplicate(["image_phash_8"]).shuffle(1)
    got = p.run(d)
    assert got.count() == 1 and "image_phash_8" in got.columns
    with pytest.raises(Exception, match="identify"):
        Pipeline("stop").extract(E.PerceptualHash).run(d).df.collect()
    assert Pipeline("go").extract(E.PerceptualHash, on_error=CONTINUE).run(d).columns == d.columns
    have = d.with_column("dummy_label", F.lit(9))
    assert Pipeline("skip").extract(E.Constant).run(have).df.first()["dummy_label"] == 9
    assert Pipeline("anew").extract(E.Constant, skip_if_present=False).run(have).df.first()["dummy_label"] == 1
    Pipeline("log", str(tmp_path)).shuffle().run(d)
    assert "shuffle" in (tmp_path / "log.log").read_text()


def test_resized_files(spark, tmp_path):
    d = Dataset.read(spark, S.files_spec(loose(tmp_path, {"a.png": picture(1, 40, 20), "b.png": picture(2, 8, 6)}), image="image_path", text="caption")).extract(E.ImageInfo())
    p = Pipeline("resize").files(Resizer(SizeMode.MAX_SIZE, 10), str(tmp_path / "new"))
    got = p.run(d).df.orderBy("width").collect()
    assert [(r["width"], r["height"]) for r in got] == [(8, 6), (10, 5)] and got[0]["image_path"].endswith("imgs/b.png")
    assert decode(open(got[1]["image_path"], "rb").read()).shape == (5, 10, 3)
    shard(tmp_path / "s", 0, {"a.png": picture(1)})
    with pytest.raises(ValueError):
        Dataset.read(spark, S.shards_spec(str(tmp_path / "s"), image="image_name")).resize_images(Resizer(SizeMode.FIXED), "/tmp/x")


def test_bytes_and_samples(spark, good):
    d = Dataset.read(spark, good)
    r = d.with_bytes("image", "blob").where("split_name = '4'").df.first()
    assert decode(r["blob"]).shape == (6, 14, 3)
    data, row = d.sample("split_name = '5'", seed=1)
    assert decode(data["image"]).shape[1] == 15 and data["text"] == row["text"]
    with pytest.raises(LookupError):
        d.sample("false")


def test_tar_source(spark, good):
    spark.dataSource.register(TarShards)
    df = spark.read.format("tarshards").option("path", good.path)
    assert df.load().count() == 36 and {r["split_name"] for r in df.option("splits", "3,5").load().collect()} == {"3", "5"}


def test_streams(spark, good, tmp_path):
    df = streaming.stream_tables(spark, good, "image_name string, caption string", 5)
    out = streaming.stream_extract(df, good, E.ImageInfo())
    q = out.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert spark.table("arrived").where("is_correct").count() == 36
    events = df.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    q = streaming.deduplicate_within(events, ["split_name"], "ts").writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 12
    assert streaming.counts_per_window(events, "ts", "split_name").isStreaming


def test_tar_with_folders_inside(tmp_path):
    write(tmp_path / "deep" / "x.bin", b"abc")
    with tarfile.open(tmp_path / "0.tar", "w") as t:
        t.add(tmp_path / "deep" / "x.bin", "some/folder/x.bin")
    assert Fetcher("tar")(f"{tmp_path}/0.tar/x.bin") == b"abc"


def test_registered_openers_reach_tasks(spark, tmp_path):
    from modalith.sources import storage
    from modalith.sources.media import with_bytes

    root = str(tmp_path / "blobs")
    write(tmp_path / "blobs" / "a.png", picture(1))
    storage.register("mem", lambda path, mode: open(f"{root}/{path.rpartition('/')[2]}", mode))
    try:
        df = spark.createDataFrame([("mem://bucket/a.png",)], "image_path string").repartition(2)
        assert bytes(with_bytes(df, S.files_spec("x.csv", image="image_path"), "image", "blob").first()["blob"]) == picture(1)
    finally:
        storage._OPENERS.pop("mem")


def test_headers_of_many_tables_take_one_job(spark, tmp_path):
    from modalith.sources.readers import headers

    paths = []
    for i in range(12):
        write(tmp_path / f"{i}.csv", f'a,"b, {i}"\n1,2\n')
        paths.append(str(tmp_path / f"{i}.csv"))
    spark.sparkContext.setJobGroup("heads", "")
    got = headers(spark, paths)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("heads")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {p: ["a", f"b, {i}"] for i, p in enumerate(paths)} and len(jobs) <= 2


def test_shuffle_repeats_however_rows_are_partitioned(spark):
    from modalith.operators import tables

    df = spark.range(500)
    one, two, other = ([r["id"] for r in tables.shuffled(d, s).collect()] for d, s in ((df.repartition(3), 1), (df.repartition(5), 1), (df, 2)))
    assert one == two != other and sorted(one) == list(range(500))
