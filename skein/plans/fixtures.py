"""Literal rows for branches that the generated tables never reach; queries add them to whole tables, the SQL as VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINKS = [
    "http://www.example.com/a/b/?utm_source=x&b=2&a=1#frag", "x: https://twitter.com/Jack/status/20?s=20", "https://x.com/jack/status/20",
    "https://www.instagram.com/reels/AbC_1/?igsh=z", "https://instagram.com/reel/AbC_1", "instagram.com/NASA", "https://www.instagram.com/explore/",
    "https://youtu.be/dQw4w9WgXcQ?t=42&si=q", "https://m.youtube.com/shorts/dQw4w9WgXcQ", "https://www.youtube.com/watch?list=a&v=dQw4w9WgXcQ",
    "https://old.reddit.com/r/Spark/comments/abc123/some_title/", "https://www.reddit.com/r/Spark/comments/abc123/some_title/def4567/?x=1",
    "https://www.reddit.com/r/Spark/comments/abc123/some_title/photos", "https://redd.it/abc123", "https://www.reddit.com/r/spark/comments/abc123/comment/def4567/",
    "https://in.pinterest.com/pin/12345/", "https://pin.it/4xYz", "https://www.linkedin.com/posts/jane_topic-activity-7123456789012345678-abcd?trk=x",
    "https://www.linkedin.com/feed/update/urn:li:activity:7123456789012345678/", "https://lnkd.in/abc", "https://t.co/xyz", "https://m.facebook.com/page/?fbclid=1&id=9",
    "[t](https://example.org/p?ref=a)", "<https://example.org/q/>", "example.com", "https://example.com/?trackingId=1", "https://netflix.com/foo/status/123",
    "https://example.com:8443/x", "https://example.com:443/x?b=2&b=1&a=c%20d", "https://github.com/a/b/issues/1", "https://github.com/a/b/pull/2", "https://sub.example.co.uk/",
    "https://localhost/", "not a url", "", "  ", "https://news.ycombinator.com/item?id=1", "https://dev.to/a", "https://medium.com/@a/b", "https://stackoverflow.com/questions/1/x",
    "https://www.linkedin.com/in/jane-doe/", "https://www.linkedin.com/jobs/view/1", "https://www.linkedin.com/pulse/a-b", "https://fb.watch/abc/", "https://bit.ly/3x",
]
TITLES = [
    'Srividya Kotnala on Instagram: "This song"', 'User (@handle) on X: "hi there"', "My Clip - YouTube", "Wait . . . what", '"Quoted"', "Foo on Bar: baz", "  ", "A &amp;lt;b&gt; c",
    "Posts • Instagram photos and videos", "“Curly”", "It\\'s &mdash; fine", "Just a moment...", "403 Forbidden",
]
DESCRIPTIONS = [
    '654K likes, 4,503 comments - srividyakotnala on July 14, 2025: "This song..."', "99 votes, 17 comments. Naa job hunt lo...", "1.2K upvotes, 45 comments. Body", 'jane.doe on July 4, 2025: "Hello"',
    "Line one\n.\n.\n.\nLine two", "Some text... Read more", "  ", "a\r\n\r\n\r\n\r\nb", "Cut off…", "Cut off...", "Reference #18.2f3 errors.edgesuite.net",
]
COUNTS = ["1.5K", "2.3M", "8.2M", "1,234", "3 likes", "5 lakh", "1.2 Cr", "12L", "-2K", "1e3", "abc", "", "1500", "2999999", "1.5k", "19,920,702", " 7 views", "1.25B", "12 comments"]
ADDRESSES = [
    "127.0.0.1", "::ffff:10.0.0.1", "100.64.0.1", "172.16.0.1", "198.19.0.1", "255.255.255.255", "2001:db8::1", "::1", "1.2.3", "256.1.1.1", "fc.example", "8.8.8.8", "100.63.255.255",
    "172.15.0.1", "192.0.1.1", "2606:4700::1", "1..2.3", "192.0.2.7", "203.0.113.9", "169.254.169.254", "", "a.b.c.d",
]
MAILS = [" A@B.co ", "a@b", "a@b.c", "a@b.c1", "@b.co", "no-at", "", "x@mail.trash.example", "x@trash.example", "y@burner.test", "y@sub.burner.test", "a" * 65 + "@b.co"]
LISTED = [("trash.example", True), ("burner.test", False)]
PASSWORDS = ["Abcdefg1", "abcdefg1", "Abcdef1", "ABCDEFG1", "Abcdefgh", "", "123456", "12345a"]
MAGIC = ["FFD8FFE0", "FFD8FF", "89504E470D0A1A0A00", "474946383961", "524946460000000057454250", "0000001C6674797061766966", "3C737667", ""]
ANSWERS = [
    '```json\n{"ai_context": " A page ", "ai_category": ["Tech", " "], "ai_tags": ["Big Data", "x"], "visual_entities": ["cat"], "ocr_text": " t "}\n```', '{"ai_tags": []}', "no json", None,
]


def frame(spark: SparkSession, rows: list, column: str, first_id: int = -1) -> DataFrame:
    """id (from -1 downwards) and one text column."""
    return spark.createDataFrame([(first_id - i, r) for i, r in enumerate(rows)], f"id long, {column} string").coalesce(1)


def numbered(rows: list, first_id: int = -1) -> list[tuple]:
    return [(first_id - i, r) for i, r in enumerate(rows)]
