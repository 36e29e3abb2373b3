"""The rules' threshold comes from every labelled row."""

import numpy as np
import pandas as pd

from winnow.llm import quality_rules as qr
from winnow.llm.textstats import text_stats


def test_threshold_is_the_cheapest_over_all_labelled_rows(spark):
    rng = np.random.default_rng(2)
    n = 20_600
    words = np.array(["plain", "words", "of", "a", "text", "##", "12", "A"])
    texts = [" ".join(rng.choice(words, 14, p=None if i % 4 else [.04, .04, .04, .04, .04, .4, .2, .2])) for i in range(n)]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(n), "text": texts}))
    y = np.array([int(rng.random() < (0.9 if i % 4 else 0.3)) for i in range(n)])
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": range(n), "quality": y}))
    forest, cut = qr.fit_rules(docs, labels)
    s = np.array([text_stats(t) for t in texts], dtype=np.int64)
    ok = ~qr.base_failed(s)
    score = forest.score(qr.rule_features(s))
    kept, lost = np.sort(score[ok & (y == 1)]), np.sort(score[ok & (y == 0)])
    at = np.unique(np.concatenate([kept, lost, [1.0]]))
    cost = qr.GOOD_COST * (len(kept) - np.searchsorted(kept, at, side="right")) + np.searchsorted(lost, at, side="right")
    best = np.nonzero(cost == cost.min())[0]
    assert cut == (at[best[0]] + at[min(best[-1] + 1, len(at) - 1)]) / 2
    assert qr.labelled_stats(docs, labels, "quality").count() == n
