import numpy as np
import pytest

from docloom.functions import jpeg
from docloom.operators import images
from docloom.plans import image_plans


def test_zigzag_begins_and_ends_as_published():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-3:].tolist() == [55, 62, 63]
    assert sorted(jpeg.ZIGZAG.tolist()) == list(range(64))


@pytest.mark.parametrize("every", [0, 3])
@pytest.mark.parametrize("halved", [False, True])
def test_round_trip(every, halved):
    rng = np.random.default_rng(0)
    smooth = np.add.outer(np.arange(37) * 3, np.arange(53) * 2)[..., None] + [0, 20, 40]
    for img, off in ((image_plans.draw_page(1), 12), (smooth.astype(np.uint8), 6), (rng.integers(0, 256, (19, 8)).astype(np.uint8), 8), (np.full((1, 1), 77, np.uint8), 3)):
        got = jpeg.decode(jpeg.encode(img, 0.5, halved, every))
        assert got.shape == img.shape
        assert np.abs(got.astype(int) - img).mean() <= off / 2 and (halved or np.abs(got.astype(int) - img).max() <= off)


def test_other_data_gives_none():
    data = jpeg.encode(image_plans.draw_page(2))
    assert jpeg.decode(b"") is None and jpeg.decode(b"\x89PNG") is None and jpeg.decode(data[: len(data) // 2]) is None
    assert jpeg.decode(data.replace(b"\xff\xc0", b"\xff\xc2", 1)) is None


def test_folders_of_both_kinds_are_decoded(spark, tmp_path):
    from docloom.sources import files

    page = image_plans.draw_page(1)
    (tmp_path / "receipt").mkdir()
    (tmp_path / "receipt/a.jpg").write_bytes(jpeg.encode(page))
    (tmp_path / "b.PNG").write_bytes(images.encode_png(page))
    (tmp_path / "c.jpeg").write_bytes(b"broken")
    rows = images.decoded(files.labelled_files(spark, str(tmp_path))).collect()
    assert {(r.label, r.image.h, r.image.w) for r in rows} == {("receipt", *page.shape[:2]), ("text_document", *page.shape[:2])}
    again = images.decoded(images.encoded(spark.createDataFrame([(images.to_value(page),)], f"image {images.IMAGE}"), "content", kind="jpeg"), out="back").first()
    assert again.back.h == page.shape[0]


def test_bits_equal_those_written_one_by_one():
    """Runs of over 16, 32 and 48 zeros, full blocks, empty ones and large values."""
    rng = np.random.default_rng(8)
    blocks = rng.integers(-900, 900, (60, 64)) * (rng.random((60, 64)) < rng.random((60, 1)) ** 3)
    blocks[0], blocks[1, 1:], blocks[2, 1:63], blocks[2, 63], blocks[3] = 0, 0, 0, 5, 1
    pairs = [0x00, 0xF0, *(run * 16 + size for run in range(16) for size in range(1, 11))]
    text = ""
    for block in blocks.tolist():
        gap = 0
        for i, v in enumerate(block):
            size = abs(v).bit_length()
            low = f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""
            if i == 0:
                text += f"{size:04b}{low}"
            elif v:
                text += f"{pairs.index(0xF0):08b}" * (gap // 16) + f"{pairs.index(gap % 16 * 16 + size):08b}{low}"
                gap = 0
            else:
                gap += 1
        text += f"{pairs.index(0):08b}" if not block[63] else ""
    text += "1" * (-len(text) % 8)
    assert jpeg._bits(blocks, pairs) == bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))
