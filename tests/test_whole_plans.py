"""Plans that take everything there is, beside those that take a part."""

from quilter.operators import blocks


def test_all_block_constants():
    names = [*blocks.CONSTANTS, *blocks.COMPOSED]
    assert len(set(names)) == 13 and {len(blocks.constant_bytes(n)) for n in names if n[:3] in ("bc2", "bc3", "bc5")} == {16}
    assert blocks.constant_bytes("bc3_transparent").hex() == "ff00ffffffffffffffff0000ffffffff"
