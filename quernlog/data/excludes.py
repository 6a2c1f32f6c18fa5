"""Exclusion lists of the detectors.  Fixed values: matched lower-case as substrings."""

COMMON_UA_TOKENS = [
    # crawlers
    "googlebot", "baiduspider", "bingbot", "yandexbot", "duckduckbot", "slurp", "spider", "crawler",
    "bot/", "bot;", "bot(",
    # command line tools and library defaults
    "curl/", "wget/", "python-requests", "python-urllib", "go-http-client", "java/", "okhttp",
    "apache-httpclient", "node-fetch", "axios/", "libwww-perl", "httpie", "scrapy",
]

BROWSER_UA_PATTERNS = [r"(?i)^mozilla/4\.", r"(?i)^mozilla/5\.0.*(chrome|safari|firefox|edge)"]
