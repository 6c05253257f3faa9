import numpy as np

from seguelake.llm import toxicity


def test_queries_do_not_disturb_one_another():
    """Queries share one table of weights; each must find what a plain product with all examples finds."""
    draw = np.random.default_rng(2)
    n_terms, k = 3000, 7

    def vector():
        terms = np.unique((n_terms * draw.random(60) ** 2).astype(np.int32))
        w = draw.random(len(terms))
        return terms, w / np.sqrt(w @ w)

    examples, queries = [vector() for _ in range(200)], [vector() for _ in range(50)]
    index = toxicity.ExampleIndex(list(range(200)), np.arange(200) % 2, examples, np.ones(200), 0.5, n_terms)
    whole = np.zeros((200, n_terms))
    for row, (terms, w) in zip(whole, examples):
        row[terms] = w
    for (terms, w), (found, cosines) in zip(queries, index.nearest_of(queries, k)):
        plain = whole[:, terms] @ w
        assert found.tolist() == np.argsort(-plain, kind="stable")[:k].tolist()
        assert np.allclose(cosines, plain[found])
    assert not index.blank.any()
