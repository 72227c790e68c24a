"""The pipeline's stage of near copies goes by SimHash and by shingles together."""

import importlib
import random

from brute import brute_near_copies

from changerisk.llm.simhash import fingerprint_of


def test_near_stage_links_by_simhash_and_shingles(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    dice = random.Random(7)
    words = [str(dice.random()) for _ in range(400)]
    texts = {50: " ".join(words)}
    repeated = " ".join(["again and again"] * 300)
    texts |= {60: f"{repeated} {' '.join(words[:40])}", 40: f"{repeated} {' '.join(words[60:260])}"}
    texts |= {70: " ".join([*words[:398], "other", "end"]), 30: " ".join(str(dice.random()) for _ in range(50))}
    assert (fingerprint_of(texts[60]) ^ fingerprint_of(texts[40])).bit_count() <= 2
    alone = brute_near_copies(list(texts.items()))
    assert alone[60] != alone[40] and alone[70] == 50  # shingles know one link, SimHash the other
    rows = [*texts.items(), (None, texts[70])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [r["doc_id"] for r in pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept) == [30, 40, 50]
