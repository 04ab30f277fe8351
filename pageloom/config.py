"""Settings and fixed values.

Every operator takes the values it needs as keyword arguments; the defaults come from here.
"""

from __future__ import annotations

from dataclasses import dataclass

# Results depend on them, so they are stated as they must be.
USEFUL_URL_PATTERNS = (
    "/article/", "/blog/", "/news/", "/post/", "/story/", "/content/", "/page/",
)
EXCLUDED_EXTENSIONS = (
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".mp4", ".avi", ".zip", ".exe", ".css", ".js",
)
TRACKING_PARAMETERS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source",
)
DOMAIN_DELAYS = {
    "wikipedia.org": 0.5,
    "github.com": 1.0,
    "stackoverflow.com": 2.0,
    "reddit.com": 3.0,
    "twitter.com": 5.0,
    "facebook.com": 5.0,
}
REMOVED_TAGS = ("script", "style", "nav", "header", "footer")
REMOVED_CLASSES = ("ad", "advertisement", "social-share", "related-posts")
CONTENT_SELECTORS = (
    "article", '[role="main"]', ".content", "#content",
    ".post-content", ".entry-content", ".article-body",
)
TITLE_SELECTORS = (
    "h1", ".title", ".post-title", ".article-title", ".entry-title", '[property="og:title"]',
)
AUTHOR_SELECTORS = (
    '[rel="author"]', ".author", ".byline", '[property="article:author"]', ".post-author",
)
DATE_SELECTORS = (
    '[property="article:published_time"]', "[datetime]", ".date", ".publish-date", "time",
)
TAG_SELECTORS = (".tags a", ".categories a", ".tag", '[property="article:tag"]')

# English words that are never keywords.
STOP_WORDS = (
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about",
    "into", "through", "during", "before", "after", "above", "below", "between", "among", "this", "that",
    "these", "those", "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its",
    "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "am", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did",
    "doing", "a", "an", "will", "would", "should", "could", "can", "may", "might", "must", "shall",
)


@dataclass(frozen=True)
class Settings:
    min_content_length: int = 100
    # The feed's title and description, which subscribers see.
    feed_title: str = "Web Crawler Feed"
    feed_description: str = "Curated content from web crawling"
    feed_home: str = "https://example.com"
    feed_url: str = "https://example.com/feed.json"
    max_feed_items: int = 50
    seed_priority: int = 10
    link_priority: int = 1


DEFAULTS = Settings()
