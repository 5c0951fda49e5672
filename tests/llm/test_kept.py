import public_tokenizers

from driftline.llm import common, packing


def test_a_task_frees_what_other_operators_keep():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = packing.encoder(path)(b"some words")
    common.lighten("packing")
    assert common.keeps("packing")
    common.lighten("near_dup")
    assert not common.keeps("packing")
    assert packing.encoder(path)(b"some words") == ids
