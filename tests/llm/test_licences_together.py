"""Several licences in one text."""

import itertools

from test_text_operators import frame

from bitloom.llm import licences


def test_no_template_displaces_another(spark):
    verbatim = [(label, t) for label, t, _ in licences.TEMPLATES]
    groups = [*itertools.combinations(verbatim, 3), tuple(verbatim)]
    texts = [" and more words here ".join(t for _, t in g) for g in groups]
    got = {x.doc_id: {f["label"] for f in x.found} for x in licences.scan(frame(spark, texts)).collect()}
    for i, g in enumerate(groups):
        assert {label for label, _ in g} <= got[i], texts[i]
