from cinderbase.llm import privacy


def test_an_address_in_capitals_is_found():
    lex = privacy.Lexicon([])
    text = "REPLY TO BOB [AT] EXAMPLE [DOT] COM SOON"
    assert [(text[a:b], kind) for a, b, kind in privacy.find(text, lex)] == [("BOB [AT] EXAMPLE [DOT] COM", "email")]
