import random

from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm.helpers import frame
from tidewire.llm.queries import tokenizer_file
from tidewire.llm.token_counts import Counter, token_counts, unigram_vocabulary


def model(vocabulary):
    table = [("<unk>", 0.0), *vocabulary]
    t = Tokenizer(models.Unigram(table, unk_id=0))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    return t


def test_counts_equal_the_library_on_ties_and_unknowns():
    """Small vocabularies with equal scores: the tie rule decides nearly every word."""
    for seed in range(40):
        rng = random.Random(seed)
        pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        vocabulary = sorted((p, -float(rng.randint(1, 4))) for p in pieces)
        # the library's lowest score includes its unknown piece
        library, counter = model(vocabulary), Counter([*vocabulary])
        for _ in range(50):
            word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))
            assert counter.count("▁" + word)[0] == len(library.encode(word).ids), (vocabulary, word)


def test_whole_texts(spark):
    vocabulary = unigram_vocabulary(tokenizer_file("piece_bpe_32k.model"))
    library = model(vocabulary)
    texts = ["Hello wörld, 你好 ☃☃ end", None, "", " \n ", "a" * 3000, "The cat. " * 2000, "same", "same"]
    got = [tuple(r)[:3] for r in token_counts(frame(spark, texts), tokenizer_file("piece_bpe_32k.model")).orderBy("doc_id").collect()]
    assert got == [(i, len(library.encode(t or "").ids), len((t or "").split())) for i, t in enumerate(texts)]
    assert token_counts(frame(spark, []), tokenizer_file("piece_bpe_32k.model")).collect() == []
