"""HTTP headers of any length."""

from misheard.llm import warc


def test_long_http_header():
    head = b"HTTP/1.1 200 OK\r\nX-Long: " + b"a" * 200_000 + b"\r\nX-Page-Id: 7\r\n\r\n"
    got, payload = warc.http_parts(head + b"body\r\n\r\nrest")
    assert got == head and bytes(payload) == b"body\r\n\r\nrest"
    assert warc.header_value(got, b"x-page-id") == "7"


def test_blocks_without_http_header():
    for block in (b"", b"HTTP/1.1 200 OK\r\n", b"text\r\n\r\nmore"):
        assert [bytes(x) for x in warc.http_parts(memoryview(block))] == [b"", block]
