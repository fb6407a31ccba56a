from quire.llm.secrets import base_spans, linked_spans


def test_secret_parts_are_whole():
    """A part that crosses the edge of an identifier's interval is reported to its end; prefixed names are identifiers."""
    secret = "wJalrXUtnFEMI7MDENGbPxRfiCYEXAMPLEKEY123"
    text = "client_id: build-bot " + "x " * 112 + secret + " end"
    at = text.index(secret)
    assert at < 276 < at + len(secret)
    assert (at, at + len(secret), "part_secret") in linked_spans(text, [])
    for name in ("aws_access_key_id", "DB_USER", "db_username", "GITHUB_CLIENT_ID"):
        text = f"{name}=build-bot\n{secret}"
        assert sorted(linked_spans(text, [])) == [(0, len(name) + 10, "part_id"), (len(name) + 11, len(text), "part_secret")]
    text = f"aws_secret_access_key={secret}"
    assert linked_spans(text, base_spans(text)) == []
    text = "password=hunter22 at https://vault.example.com/v1 today"
    assert linked_spans(text, base_spans(text)) == [(21, 49, "part_endpoint")]
