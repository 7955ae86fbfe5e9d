from pyspark.sql import functions as F

from pagedrift.functions import text

NORMALIZE = [
    ("Hawaii   Vacation    Package     Available", "Hawaii Vacation Package Available"),
    ("Special Deal 12/25/2024 expires 01/15/25 at 11:59 PM", "Special Deal expires at"),
    ("Promotion 2024-01-15 available now", "Promotion available now"),
    ("Great deal ABC123XYZ ref:TRACK001 utm_source=email", "Great deal"),
    ("Popular package 1,234 views 567 clicks this week", "Popular package this week"),
    (
        "Amazing cruise deal\nUpdated: January 15, 2024 at 3:30 PM\nBook now!",
        "Amazing cruise deal\nBook now!",
    ),
    ("", ""),
    (None, ""),
    ("Line 1\n\n\nLine 2\n   \nLine 3", "Line 1\nLine 2\nLine 3"),
    (
        "\n      Hawaii Vacation Package    \n      Updated: 12/15/2024 at 2:30 PM\n"
        "      1,456 views     234 clicks\n      Tracking: UTM123ABC   ref:EMAIL001\n      \n"
        "      \n      Special pricing available!\n    ",
        "Hawaii Vacation Package \nSpecial pricing available!",
    ),
    # ASCII word edges: a code right after an accented letter is still a code.
    ("éABCDEFGH1 x", "é x"),
    # Wide blanks are trimmed.
    ("  deal　", "deal"),
]
NOISE = [
    ("Limited time offer! Act now before it expires!", "offer! before it expires"),
    ("Amazing cruise deal - Call now to book today!", "Amazing cruise deal - to"),
    ("Great price *Terms and conditions apply* for everyone", "Great price for everyone"),
    ("Special rate (see terms and conditions) available now", "Special rate available now"),
    ("500 people booked this trending package today", "this package today"),
    (
        "Limited time! Top rated cruise *restrictions apply* - 1,000 customers viewed this "
        "popular deal. Call now!",
        "cruise - this deal.",
    ),
    ("", ""),
    (None, ""),
    (
        "Hawaii vacation package includes flights and hotel",
        "Hawaii vacation package includes flights and hotel",
    ),
    ("HURRY! Book Today! LIMITED TIME offer expires soon!", "! offer"),
    ("Please don't wait for it", "Please for it"),
]
BOTH = [
    (
        "Hawaii Special 12/25/2024 Limited time! 1,234 views 7 nights $899",
        "Hawaii Special ! 7 nights $899",
    ),
    (
        "Trending! 7-day Alaska cruise from $599 *see terms* - 500 people viewed this popular "
        "deal today! Book now!",
        "7-day Alaska cruise from $599 - this deal today! Book now",
    ),
]


def check(values, function, pairs):
    got = values(function, [(given,) for given, _ in pairs], ["string"])
    assert got == [expected for _, expected in pairs]


def test_normalize(values):
    check(values, text.normalize_text, NORMALIZE)


def test_noise(values):
    check(values, text.filter_noise, NOISE)


def test_clean(values):
    check(values, text.clean_text, BOTH)


def test_promo_id(values):
    base = ("Hawaii Vacation Package", "Free breakfast and WiFi", "March", "From $899 per person")
    ids = values(
        text.promo_id,
        [
            base,
            base,
            ("Hawaii   Vacation Package  ", *base[1:]),
            ("Alaska Cruise", *base[1:]),
            (base[0], base[2], base[1], base[3]),
            ("a", "", "", ""),
            ("", "a", "", ""),
        ],
        ["string"] * 4,
    )
    assert ids[0] == ids[1] == ids[2]
    assert len({ids[0], *ids[3:]}) == 5
    assert all(len(i) == 16 and set(i) <= set("0123456789abcdef") for i in ids)


def test_keys(values):
    import hashlib

    url, iso = "https://a.example.com/x", "2025-01-08T10:00:00Z"
    digest = hashlib.sha256(url.encode()).hexdigest()[:16]
    assert values(text.state_key, [(url,)], ["string"]) == [f"state:{digest}"]
    assert values(text.history_key, [(url, iso)], ["string"] * 2) == [f"hist:{digest}:{iso}"]


def test_escape(values):
    pairs = [
        ("Deal with *asterisks* & <brackets>", r"Deal with \*asterisks\* &amp; &lt;brackets&gt;"),
        ("Free _under_ and ~tildes~ `ticks`", r"Free \_under\_ and \~tildes\~ \`ticks\`"),
        ("a<script>alert(1)</script>b", "ab"),
        ('<a href="javascript:x" onclick="y">', "&lt;a href=&quot;x&quot; &quot;y&quot;&gt;"),
        ("x" * 4000, "x" * 3000),
        (None, ""),
    ]
    check(values, lambda c: text.escape_markup(c, 3000), pairs)


def test_entities_and_artifacts(values):
    pairs = [
        ("&quot;A&quot; &amp; &#x27;B&#x27; &bull; &diams;&nbsp;x", "\"A\" & 'B' • ♦ x"),
        ("mas: tant savings", "Instant savings"),
        ("gital Shop Card", "Digital Shop Card"),
        ("or call  us today", "us today"),
        ("Home Vacation Packages Maui", "Maui"),
    ]
    check(values, text.decode_entities, pairs)


def test_html_to_text(values):
    html = "<p>a</p><script>x<y</script>\n<style>b</style><b>c</b>"
    assert values(text.html_to_text, [(html,)], ["string"]) == [" a c "]
    kept = values(lambda h: text.html_to_text(h, False), [("<script>x</script>y",)], ["string"])
    assert kept == [" x y"]


def test_relative_age(values):
    as_of = F.lit("2025-01-18 10:30:00").cast("timestamp")
    pairs = [
        ("2025-01-18T10:29:31Z", "just now"),
        ("2025-01-18T10:29:00Z", "1 minute ago"),
        ("2025-01-18T10:25:00Z", "5 minutes ago"),
        ("2025-01-18T09:30:00Z", "1 hour ago"),
        ("2025-01-16T10:30:00Z", "2 days ago"),
        ("2025-01-08T10:30:00Z", "Jan 8, 10:30 AM"),
        ("2025-01-08T00:05:00Z", "Jan 8, 12:05 AM"),
        ("2026-01-08T10:30:00Z", "just now"),
        ("no time", "no time"),
    ]
    check(values, lambda c: text.relative_age(c, as_of), pairs)


def test_truncate(values):
    rows = [("a" * 12,), ("a" * 10,), ("",)]
    got = values(lambda c: text.truncate_text(c, 10), rows, ["string"])
    assert got == ["a" * 10 + "... [truncated]", "a" * 10, ""]
