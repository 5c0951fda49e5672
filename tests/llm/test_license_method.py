from driftline.llm import licenses

TEXT = "x. " + licenses.TEMPLATES["Apache-2.0"][1] + " y."


def test_compression_comes_before_the_wording(monkeypatch):
    """A block of which the template saves too little is not a candidate, so its wording is not looked at."""
    asked, confirm = [], licenses._confirm
    monkeypatch.setattr(licenses, "_confirm", lambda *x: asked.append(x) or confirm(*x))
    assert [x[2] for x in licenses.notices(TEXT)] == ["Apache-2.0"] and asked
    asked.clear()
    monkeypatch.setattr(licenses, "LEAST_SAVED", 2)
    assert licenses.notices(TEXT) == [] and not asked


def test_the_template_that_saves_most_bytes_is_taken(monkeypatch):
    whole, saved = licenses.notices(TEXT)[0], licenses._saved
    assert TEXT[whole[0] : whole[1]] == licenses.TEMPLATES["Apache-2.0"][1]
    short = next(k for k, t in enumerate(licenses._templates()) if t[0] == "Apache-2.0")
    monkeypatch.setattr(licenses, "_saved", lambda block, k: (10**6, 0.9) if k == short else saved(block, k))
    found = licenses.notices(TEXT)
    assert found[0][1] < whole[1] and found[0][3] == 0.9
