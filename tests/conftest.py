import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from broadsheet.session import get_spark
    s = get_spark("local[*]", 8, app_name="broadsheet-tests")
    yield s


SAMPLE_HTML = """<!DOCTYPE html>
<html>
<head>
    <title>Test Article Title</title>
    <meta name="author" content="John Doe">
    <meta property="article:published_time" content="2024-01-15">
</head>
<body>
    <header><nav>Navigation</nav></header>
    <article>
        <h1>Main Article Heading</h1>
        <p>This is the first paragraph of the article. It contains important information.</p>
        <p>This is the second paragraph with more details about the topic.</p>
        <p>The third paragraph concludes the article with final thoughts.</p>
    </article>
    <footer>Footer content</footer>
</body>
</html>"""

SAMPLE_TEXT = """This is a sample article text.
It has multiple lines and sentences.

Some paragraphs are separated by blank lines.
The content is meant for testing purposes.
It should be long enough to test various text processing functions.
"""


@pytest.fixture
def sample_html():
    return SAMPLE_HTML


@pytest.fixture
def sample_text():
    return SAMPLE_TEXT


def rows(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]
