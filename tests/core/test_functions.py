import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modalith.functions import captions, images, language
from modalith.functions import columns as X
from modalith.operators.transforms import Resizer, VideoTransform
from modalith.plans import catalog
from modalith.sources import storage
from tests.core.files import picture

FIXED, LEAST, MOST = X.SizeMode.FIXED, X.SizeMode.MIN_SIZE, X.SizeMode.MAX_SIZE
SIZES = [
    (Resizer(FIXED, fixed=(768, 768)), [((768, 768), (768, 768)), ((0, 0), (768, 768)), ((1024, 768), (768, 768)), ((2048, 1333), (768, 768))]),
    (Resizer(LEAST), [((768, 768), (512, 512)), ((1024, 2048), (512, 1024)), ((2048, 1024), (1024, 512)), ((128, 128), (128, 128)), ((128, 512), (128, 512))]),
    (Resizer(MOST), [((768, 768), (512, 512)), ((1024, 2048), (256, 512)), ((2048, 1024), (512, 256)), ((128, 128), (128, 128)), ((128, 512), (128, 512))]),
    (Resizer(MOST, downscale_only=False), [((256, 256), (512, 512)), ((128, 256), (256, 512)), ((256, 128), (512, 256))]),
    (Resizer(LEAST, downscale_only=False), [((256, 256), (512, 512)), ((128, 256), (512, 1024)), ((256, 128), (1024, 512))]),
]


@pytest.mark.parametrize("resizer,cases", SIZES)
def test_sizes(spark, resizer, cases):
    assert [resizer.new_size(*old) for old, _ in cases] == [new for _, new in cases]
    got = spark.createDataFrame([old for old, _ in cases], "w int, h int").select(resizer.column(F.col("w"), F.col("h")).alias("s")).collect()
    assert [tuple(r["s"]) for r in got] == [new for _, new in cases]


def test_column_and_function_agree_on_sizes(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(1, 4000), rng.randrange(1, 4000)) for _ in range(500)]
    df = spark.createDataFrame(pairs, "w int, h int")
    for mode in (LEAST, MOST):
        for down in (True, False):
            r = Resizer(mode, 333, downscale_only=down)
            assert [tuple(x["s"]) for x in df.select(r.column(F.col("w"), F.col("h")).alias("s")).collect()] == [r.new_size(*p) for p in pairs]


def test_paths(spark):
    df = spark.createDataFrame([("s3://b/x.csv/3.tar/a.b.png",), ("plain",), ("a.csv",)], "p string")
    p = F.col("p")
    rows = df.select(X.base_name(p), X.path_stem(p), X.extension(p), X.with_extension(p, "csv", "tar"), X.without_prefix(p, "s3://b/")).collect()
    assert [tuple(r) for r in rows] == [("a.b.png", "a", ".png", "s3://b/x.csv/3.tar/a.b.png", "x.csv/3.tar/a.b.png"), ("plain", "plain", "", "plain", "plain"), ("a.csv", "a", ".csv", "a.tar", "a.csv")]
    assert storage.join("s3://b/data", "shards/") == storage.join("s3://b/data/", "shards/") == "s3://b/data/shards"
    assert storage.join("s3://b/data/", "shards", "1.tar") == "s3://b/data/shards/1.tar"
    with pytest.raises(storage.UnknownTableFormat):
        storage.table_format("x.txt")


def test_frames_boxes_and_answers(spark):
    one = spark.range(1)
    got = one.select(
        X.sampled_frames(12, 2, F.lit(100)), X.sampled_frames(12, 2, F.lit(12)), X.sampled_frames(12, 9, F.lit(26)), X.padded(F.lit(13)),
        X.clamped_box(F.array(F.array(F.lit(50), F.lit(-3)), F.array(F.lit(10), F.lit(99))), F.lit(40), F.lit(30)),
        X.text_area(F.array(F.array(F.array(F.lit(0), F.lit(0)), F.array(F.lit(2), F.lit(5)))), F.lit(10), F.lit(10)),
        X.model_answer(F.lit(" hi assistant\n a cat.</s> rest"), after="assistant"), X.model_answer(F.lit("a cat###"), stop="###"),
        X.boxes_from_json(F.lit('[[[[1, 2], [3, 4]], "a"]]')),
    ).first()
    assert list(got)[:3] == [[12, 24], [], [12, 24]] and tuple(got[3]) == (1, 2)
    assert tuple(got[4]) == (10, 0, 40, 30) and got[5] == 0.1 and got[6] == "a cat." and got[7] == "a cat" and tuple(got[8][0]) == ([[1, 2], [3, 4]], "a")


def test_heads_collapse():
    w, b = X.collapse([([[1, 2], [3, 4]], [1, 1]), ([[2, -1]], [0.5])])
    v = np.array([0.3, -2])
    assert np.isclose(np.dot(w, v) + b, (np.array([[2, -1]]) @ (np.array([[1, 2], [3, 4]]) @ v + 1) + 0.5)[0])
    assert np.isclose(np.linalg.norm(X.prototype([[3, 4], [0, 0]])), 1) and X.label_prompts(" cat ", ["a {}"]) == ["a cat"]


def test_every_rule_works_in_both_flavours(spark):
    for name, rules in captions.RULES.items():
        for p, _ in rules:
            re.compile(p)
        spark.range(1).select(captions.clean_native(F.lit("Stock photo 123"), rules)).collect()
        assert rules, name


CAPTIONS = [
    ("en", "Shutterstock", ""),
    ("en", "royalty free stock photo", " "),
    ("special", "Line\nbreak #12 [tag] 10.0.0.1 won't", "Line break will not"),
    ("special", "they'll - - go http://x.y/z", "they would - - go "),
    ("emoji", "hi \U0001f600\U0001f601!", "hi  !"),
    ("ru", "Телефон Samsung", " Samsung"),
    ("ru", "Красивый вид, купить со скидкой", "Красивый вид, "),
    ("ru", "размер 40-42 Платье", "размер  Платье"),
]


@pytest.mark.parametrize("name,caption,_", CAPTIONS)
def test_clean_is_the_fold_of_cut(spark, name, caption, _):
    want = caption
    for p, r in captions.RULES[name]:
        want = captions.cut(want, re.compile(p), r)
    got = spark.createDataFrame([(caption,), (None,), ("",)], "c string").select(captions.clean(F.col("c"), captions.RULES[name])).collect()
    assert [r[0] for r in got] == [want, None, ""]
    if name in ("emoji", "ru"):
        assert want == _


def test_language_rules_are_a_query(spark, tmp_path):
    texts = [c for _, c, _ in CAPTIONS] + [None, ""]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in catalog.QUERIES["regex_clean_exact_languages"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        for name in ("en", "ru"):
            want = t
            for p, r in captions.RULES[name] if t else ():
                want = captions.cut(want, re.compile(p), r)
            assert got[i][f"clean_caption_{name}"] == want


def test_language_rules_share_one_worker_and_few_texts(spark, tmp_path):
    texts = [f"Photo {i} of 5 купить со скидкой" if i % 7 else None for i in range(259)]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    df = catalog.QUERIES["regex_clean_exact_languages"](spark, str(tmp_path))
    assert str(df._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1
    sets = {k: captions.RULES[k] for k in ("en", "ru")}
    want = []
    for t in texts:
        made = dict.fromkeys(sets, t)
        for k, rules in sets.items():
            for p, r in rules if t else ():
                made[k] = captions.cut(made[k], re.compile(p), r)
        want.append(made)
    assert [(r["clean_caption_en"], r["clean_caption_ru"]) for r in df.orderBy("conv_id").collect()] == [(w["en"], w["ru"]) for w in want]
    slices = list(captions.swept([pa.array(texts), pa.array([], pa.string())], sets))
    assert max(map(len, slices)) == captions.SLICE and [x for s in slices for x in s.to_pylist()] == want


def test_cut_works_on_the_stripped_lower_case():
    rule = re.compile("photo")
    assert captions.cut("A PHOTO of", rule, "") == "A  of"
    assert captions.cut("  photo x", rule, "") == "to x"  # places are those of the stripped caption
    assert captions.cut("x rf ", re.compile("rf$"), "") == "x  "


@given(st.lists(st.text(max_size=12), max_size=12), st.integers(1, 20))
@settings(max_examples=150, deadline=None)
def test_requests_hold_every_text_once(texts, budget):
    got = list(language.request_batches(texts, budget))
    assert sorted(t for b in got for t in b) == sorted(texts)
    assert all(b and (len(b) == 1 or sum(map(len, b)) < budget) for b in got)


def test_translation(spark):
    calls = spark.sparkContext.accumulator(0)

    def client(texts):
        calls.add(1)
        if any("bad" in t for t in texts):
            raise OSError("no line")
        return [t[::-1] for t in texts]

    df = spark.createDataFrame([("abc",), ("abc",), (None,), ("bad one",)], "t string")
    got = language.translated(df.coalesce(1), "t", client, budget=5, retries=0).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("abc", "cba"), ("abc", "cba"), (None, None), ("bad one", None)], key=str)


def test_whole_texts_are_translated(spark, tmp_path):
    texts = ["", "a", "x" * 2999, "y" * 3000, "z" * 7001, *(f"{i} " * 300 for i in range(40)), None, "a"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["text"], r["text_translated"]) for r in catalog.QUERIES["translate_texts"](spark, str(tmp_path)).collect()}
    assert got == {i: (t, None if t is None else f"{len(t)}:{t}!") for i, t in enumerate(texts)}


def test_language(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("lang", language.language(F.col("text")).alias("l"))
    assert d.where("lang = l.lang").count() > 0.9 * d.count()
    assert language.identify(None) == language.identify("12 !") == (None, None)


def test_images():
    for c in (1, 2, 3, 4):
        blob = picture(c, 31, 17, c)
        assert images.image_size(blob) == (31, 17, c) and images.decode(blob).shape == (17, 31, c) and images.rgb(images.decode(blob)).shape == (17, 31, 3)
    with pytest.raises(images.BadImage):
        images.decode(b"no image")
    with pytest.raises(images.BadImage):
        images.decode(picture(1)[:60])
    assert images.perceptual_hash(images.decode(picture(3))) == images.perceptual_hash(images.decode(picture(3)))
    px = np.kron(np.random.default_rng(0).integers(0, 255, (8, 8, 3)), np.ones((16, 16, 1))).astype(np.uint8)
    a, b = images.perceptual_hash(px), images.perceptual_hash(images.resize(px, 100, 90))
    assert len(a) == 48 and bin(int(a, 16) ^ int(b, 16)).count("1") < 20
    assert bin(int(a, 16) ^ int(images.perceptual_hash(images.decode(picture(5))), 16)).count("1") > 50


def test_png_filters_match_the_jvm(spark, tmp_path):
    """Every filter type, on random bytes."""
    import struct
    import zlib

    rng = np.random.default_rng(2)
    px = rng.integers(0, 255, (10, 7, 3)).astype(np.uint8)
    raw, above = b"", np.zeros(21, int)
    for y in range(10):
        line, kind = px[y].reshape(-1).astype(int), y % 5
        left = np.concatenate([np.zeros(3, int), line[:-3]])
        corner = np.concatenate([np.zeros(3, int), above[:-3]])
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        guess = [np.zeros(21, int), left, above, (left + above) // 2, paeth][kind]
        raw += bytes([kind]) + bytes(((line - guess) & 255).astype(np.uint8))
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    blob = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (images.decode(blob) == px).all()
    (tmp_path / "x.png").write_bytes(blob)
    data = spark.read.format("image").load(str(tmp_path)).select("image.data").first()[0]
    assert (np.frombuffer(bytes(data), np.uint8).reshape(10, 7, 3)[:, :, ::-1] == px).all()


def test_video_commands():
    t = VideoTransform(Resizer(MOST, 512), fps=25, cut_start="s", cut_duration="d", crf=20)
    assert t.required == ["width", "height", "fps", "s", "d"] and t.changed == ["width", "height", "fps"]
    c = t.command("a.mp4", "b.mp4", {"width": 1000, "height": 501, "fps": 30.0, "s": 1.5, "d": 2})
    assert c == ["ffmpeg", "-hide_banner", "-ss", "1.5", "-i", "a.mp4", "-t", "2", "-vf", "scale=512:256,fps=25", "-crf", "20", "-c:a", "copy", "b.mp4", "-y"]
    assert t.command("a", "b", {"width": 100, "height": 50, "fps": 25.05, "s": None, "d": None}) is None
    assert VideoTransform(cut_start="s", cut_duration="d", copy_stream=True).command("a", "b", {"s": 0, "d": 1})[4:9] == ["-i", "a", "-t", "1", "-c"]
    for bad in ({}, {"cut_start": "s"}, {"fps": 3, "cut_start": "s", "cut_duration": "d", "copy_stream": True}):
        with pytest.raises(ValueError):
            VideoTransform(**bad)


def test_images_that_end_early_are_damaged():
    from modalith.operators.extractors import ImageInfo

    frame = b"\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03\x01\x22\x00\x02\x11\x01\x03\x11\x01"
    jpeg = b"\xff\xd8" + frame + b"\xff\xda\x00\x0c\x03\x01\x00\x02\x11\x03\x11\x00\x3f\x00" + b"\x12\x34" * 20 + b"\xff\xd9"
    gif = b"GIF89a\x04\x00\x03\x00\x00\x00\x00" + b"x" * 20 + b";"
    facts = lambda blob: ImageInfo().prepare({"image": blob}, {})
    assert facts(jpeg)[:4] == (True, 32, 16, 3) and facts(gif)[:3] == (True, 4, 3)
    assert not facts(jpeg[:30])[0] and not facts(jpeg[:-2])[0] and not facts(gif[:-4])[0]


@pytest.mark.parametrize(
    "name,caption,want",
    [
        ("en", "An old barn, royalty free stock photo 12345 at https://x.com/a?b=1", "An old barn,"),
        ("en", "Vase 10 x 20 cm (3) for sale", "Vase"),
        ("en", "photo.jpg of a dog", "of a dog"),
        ("en", "a man with a beard", "a man with a beard"),
        ("ru", "Красивая собака, стоковое фото 123", "Красивая собака,"),
        ("ru", "Ваза 10х20 см купить за 300 руб.", "Ваза"),
        ("ru", "кошка спит на диване", "кошка спит на диване"),
        ("special", "I'll stay - - - home #12 [tag] 10.0.0.1", "I would stay - home"),
    ],
)
def test_captions_lose_what_is_no_caption(name, caption, want):
    for p, r in captions.RULES[name]:
        caption = captions.cut(caption, re.compile(p), r)
    assert " ".join(caption.split()) == want
