"""Fixed values.

Everything in this module must keep the exact value the source application
uses for results to match: character classes, URL patterns, enums, icons,
widths and prompt wording.  Values are listed plainly, in natural order.
"""

# --- fixed values: whitespace -------------------------------------------------
# The JavaScript `\s` class.  Java and RE2 `\s` are ASCII only, so the class is
# spelled out; the same text works in Spark (Java regex) and DuckDB (RE2).
JS_SPACE = (
    r"\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)

# The same set as code points, for character-set trimming.
JS_SPACE_CODEPOINTS = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
]
JS_SPACE_CHARS = "".join(chr(c) for c in JS_SPACE_CODEPOINTS)

# --- fixed values: URL and handle patterns ------------------------------------
URL_PATTERN = r"https?://[^" + JS_SPACE + r"]+"
HANDLE_PATTERN = r"@(\w+)"
VIDEO_ID_PATTERN = (
    r"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/shorts/)([a-zA-Z0-9_-]{11})"
)
# URLs that are not articles (tested unanchored, as the source does).
SKIP_PATTERNS = [
    r"youtube\.com",
    r"youtu\.be",
    r"twitter\.com",
    r"x\.com",
    r"github\.com/.*/(blob|tree|commit)",
    r"(?i)\.(png|jpg|jpeg|gif|webp|svg|mp4|mp3|pdf)$",
]
# Host-anchored variant of the first four patterns (ours, stricter).
SKIP_HOSTS = ["youtube.com", "youtu.be", "twitter.com", "x.com"]

# --- fixed values: enums ------------------------------------------------------
CATEGORIES = ["review", "try", "knowledge", "podcast", "video", "article", "tool", "project", "fun"]
STATUSES = ["processing", "completed", "failed"]
MEDIA_TYPES = ["photo", "video", "animated_gif"]
PRIORITIES = ["now", "this-week", "someday"]
LINK_TYPES = ["article", "tool", "repo", "video", "docs", "other"]
CONTENT_TYPES = ["tweet", "thread", "article_share", "video_share", "image_post", "tool_announcement", "discussion"]
ESTIMATED_VALUES = ["high", "medium", "low", "skip"]
ARTICLE_PRIORITIES = ["high", "medium", "low"]
IMAGE_KINDS = ["screenshot", "diagram", "photo", "meme", "chart", "code", "other"]
ERROR_CODES = ["AUTH_EXPIRED", "RATE_LIMIT", "NETWORK", "PARSE", "NOTION", "TELEGRAM", "UNKNOWN"]

# --- fixed values: widths -----------------------------------------------------
TOPIC_WIDTH = 50
FOR_YOU_WIDTH = 250
TOP_ACTION_WIDTH = 100
TLDR_WIDTH = 280
SUMMARY_WIDTH = 2000
QUOTE_WIDTH = 2000
TOGGLE_WIDTH = 2000
ARTICLE_PROMPT_CUT = 8000
TRANSCRIPT_PROMPT_CUT = 6000
TRUNCATED_MARKER = "\n\n[...truncated]"
MAX_TAGS = 7
MAX_IMAGES = 4
MAX_INSIGHTS = 5
MAX_LINKS = 5
MAX_TOP_PICKS = 3
TOP_TAGS = 10
TOP_HIGHLIGHTS = 10
HIGHLIGHT_SCORE = 8
DIGEST_CHUNK = 4000
MESSAGE_HARD_CUT = 4096
WEEK_DAYS = 7

# --- fixed values: icons ------------------------------------------------------
SCORE_MARK = "🔥"
SCORE_BANDS = [(9, 3), (7, 2), (4, 1)]  # score >= first -> that many marks
LINK_ICONS = {"tool": "🛠️", "repo": "📦", "video": "🎬", "docs": "📚"}
LINK_ICON_DEFAULT = "🔗"
ERROR_ICONS = {
    "AUTH_EXPIRED": "🔑",
    "RATE_LIMIT": "⏱️",
    "NETWORK": "🌐",
    "PARSE": "⚠️",
    "NOTION": "📝",
    "TELEGRAM": "💬",
}
ERROR_ICON_DEFAULT = "❌"
DEFAULT_PRIORITY = "someday"
POST_URL_PREFIX = "https://x.com/"
PUBLISHED_TABLE_TITLE = "saved_posts"

# --- fixed values: message texts ----------------------------------------------
# Layout of the digest and alert messages (titles reworded where they named
# the original product).
DIGEST_TITLE = "# 📚 Weekly Bookmark Digest\n\n"
DIGEST_TOP_PICKS = "\n\n## 🎯 Top Picks This Week\n"
DIGEST_PATTERNS = "\n\n## 📊 Patterns Noticed\n"
DIGEST_RECOMMENDATIONS = "\n\n## 💡 Recommendations\n"
ALERT_ERROR = (
    "{icon} <b>Curation Error</b>\n\n<b>Type:</b> {code}\n"
    "<b>Message:</b> {message}\n<b>Status:</b> {status}"
)
ALERT_RETRY = "(will retry)"
ALERT_MANUAL = "(manual action needed)"
ALERT_AUTH = (
    "🔑 <b>Twitter Auth Expired</b>\n\n"
    "Cookies have expired. Please update them:\n"
    "1. Log into X in Chrome\n"
    "2. Restart the curation job\n\n"
    "Processing paused until auth is restored."
)
STATS_TITLE = "📊 <b>Curation Stats</b>\n\n"
ERROR_RATE_LIMIT = "Twitter rate limit hit"
ERROR_UNKNOWN_COMMAND = "bookmarks command not available in the source tool; update it"
ERROR_NETWORK_PREFIX = "Source tool error: "

# --- fixed values: section separators of the analysis prompt --------------------
PROMPT_SECTION_SEP = "\n\n---\n\n"

# --- fixed values: prompt structure ----------------------------------------------
# Section headers and line shapes of the two model requests.  The free-form
# instructions (the reader's profile and the task) are parameters with short
# defaults of our own, see `quire.operators.inference`.
PROMPT_USER_CONTEXT = "## USER CONTEXT (for personalized scoring)\n"
PROMPT_ORIGINAL = "## ORIGINAL TWEET\n"
PROMPT_THREAD = "## THREAD CONTINUATION ({n} more tweets)\n"
PROMPT_ARTICLES = "## ARTICLE CONTENT\n"
PROMPT_TRANSCRIPTS = "## VIDEO TRANSCRIPTS\n"
PROMPT_IMAGES = "## IMAGE ANALYSIS\n"
PROMPT_TASK = "## YOUR TASK\n"
