"""Task signatures, application and title rules, word lists.

The results depend on exactly these values, so they are written out as plain text in their natural
order. Where a list is checked in order, the first hit wins.
"""

from __future__ import annotations

# fixed values: behavioural signatures, in tie-break order
# task | intensity | continuity | entropy | app diversity | duration | minimum confidence | sticky | display name
SIGNATURES = [
    ("deep_development", 0.8, 0.85, 0.2, 0.2, 2.0, 0.65, True, "Deep Development"),
    ("technical_research", 0.4, 0.6, 0.5, 0.5, 1.0, 0.55, False, "Technical Research"),
    ("context_switching", 0.5, 0.2, 0.85, 0.8, 0.3, 0.5, False, "Context Switching"),
    ("team_meeting", 0.2, 0.7, 0.1, 0.1, 0.75, 0.75, True, "Team Meeting"),
    ("administrative_work", 0.45, 0.4, 0.55, 0.5, 0.5, 0.5, False, "Administrative Work"),
    ("strategic_planning", 0.3, 0.75, 0.3, 0.3, 1.5, 0.55, False, "Strategic Planning"),
    ("content_creation", 0.6, 0.7, 0.3, 0.3, 1.5, 0.55, False, "Content Creation"),
    ("code_review", 0.4, 0.65, 0.4, 0.3, 0.5, 0.6, False, "Code Review"),
    ("debugging", 0.7, 0.6, 0.6, 0.4, 1.0, 0.6, False, "Debugging"),
    ("learning", 0.3, 0.7, 0.4, 0.4, 1.0, 0.55, False, "Learning"),
    ("email_communication", 0.5, 0.5, 0.4, 0.2, 0.4, 0.65, False, "Email Communication"),
    ("chat_messaging", 0.6, 0.4, 0.5, 0.3, 0.3, 0.6, False, "Chat & Messaging"),
    ("documentation", 0.5, 0.7, 0.3, 0.2, 0.8, 0.6, False, "Documentation"),
    ("data_analysis", 0.6, 0.65, 0.35, 0.3, 1.0, 0.6, False, "Data Analysis"),
    ("system_maintenance", 0.5, 0.5, 0.5, 0.5, 0.6, 0.55, False, "System Maintenance"),
    ("browsing_research", 0.4, 0.5, 0.6, 0.4, 0.5, 0.5, False, "Web Browsing & Research"),
    ("video_conferencing", 0.2, 0.8, 0.1, 0.1, 0.75, 0.75, True, "Video Conferencing"),
    ("content_consumption", 0.2, 0.7, 0.3, 0.3, 0.6, 0.55, False, "Content Consumption"),
    ("task_management", 0.5, 0.6, 0.4, 0.3, 0.4, 0.6, False, "Task Management"),
    ("file_management", 0.6, 0.4, 0.5, 0.3, 0.3, 0.55, False, "File Management"),
    ("general_productivity", 0.5, 0.5, 0.5, 0.5, 0.5, 0.4, False, "General Productivity"),
    ("idle_break", 0.1, 0.3, 0.2, 0.2, 0.2, 0.5, False, "Idle / Break"),
]

# fixed values: weights of the signature distance (intensity, continuity, entropy, diversity, duration)
SIGNATURE_WEIGHTS = (1.5, 1.2, 1.5, 0.8, 0.6)
SIGNATURE_SCALE = 3.5

# fixed values: task -> app name parts, in the order they are tried (confidence .85)
APP_RULES = [
    ("deep_development", ["code.exe", "vscode", "visual studio", "pycharm", "intellij", "sublime", "atom", "vim"]),
    ("email_communication", ["outlook", "thunderbird", "mail"]),
    ("chat_messaging", ["slack", "discord", "telegram", "whatsapp", "signal"]),
    ("video_conferencing", ["zoom", "meet", "webex", "skype"]),
    ("data_analysis", ["excel", "powerbi", "tableau"]),
    ("documentation", ["word", "notion", "onenote", "confluence"]),
    ("task_management", ["jira", "trello", "asana", "todoist"]),
    ("system_maintenance", ["terminal", "powershell", "cmd", "bash"]),
    ("file_management", ["explorer", "finder"]),
]
APP_RULE_CONFIDENCE = 0.85
RULE_BROWSERS = ["firefox", "chrome", "edge", "safari", "brave"]
# fixed values: what a browser title says, in order (confidence .75, otherwise browsing at .65)
BROWSER_TITLE_RULES = [
    ("technical_research", ["github", "gitlab", "stackoverflow", "docs"]),
    ("content_consumption", ["youtube", "netflix", "spotify"]),
    ("email_communication", ["gmail", "mail", "inbox"]),
    ("chat_messaging", ["teams", "slack", "discord"]),
]
TEAMS_CALL_WORDS = ["call", "meeting", "video"]

# fixed values: title words -> task and confidence, in order
TITLE_RULES = [
    (["github", "gitlab", "pull request", "merge request", "code review"], "code_review", 0.75),
    (["debug", "debugger", "breakpoint", "stack trace", "error"], "debugging", 0.7),
    (["terminal", "command", "bash", "powershell", "cmd"], "system_maintenance", 0.7),
    (["tutorial", "course", "learn", "udemy", "coursera", "lesson"], "learning", 0.75),
    (["documentation", "docs", "api reference", "manual"], "technical_research", 0.7),
    (["email", "inbox", "gmail", "outlook"], "email_communication", 0.75),
    (["chat", "message", "slack", "discord", "teams"], "chat_messaging", 0.75),
    (["zoom", "meeting", "call", "webinar"], "video_conferencing", 0.8),
    (["youtube", "video", "watch"], "content_consumption", 0.75),
    (["netflix", "hulu", "prime video", "spotify"], "content_consumption", 0.8),
    (["google", "search", "stackoverflow", "reddit"], "browsing_research", 0.65),
    (["article", "blog", "news", "medium"], "browsing_research", 0.65),
    (["todo", "task", "jira", "trello", "project"], "task_management", 0.7),
    (["calendar", "schedule", "meeting", "appointment"], "task_management", 0.7),
    (["spreadsheet", "excel", "data", "analytics"], "data_analysis", 0.7),
    (["word", "document", "write", "draft"], "documentation", 0.65),
    (["design", "figma", "photoshop", "illustrator"], "content_creation", 0.75),
    (["edit", "editing", "premiere", "davinci"], "content_creation", 0.75),
]

# fixed values: what counts as a conference in the video-conference guard
CONFERENCE_APPS = ["zoom", "teams", "meet", "webex", "skype"]
CONFERENCE_WORDS = ["zoom", "meeting", "call", "webinar", "teams", "meet"]
GUARD_BROWSERS = ["browser", "firefox", "chrome", "edge", "safari", "brave"]

# fixed values: title cleaning
BROWSER_SUFFIXES = [
    "Mozilla Firefox", "Google Chrome", "Microsoft Edge", "Safari", "Opera", "Brave Browser", "Firefox", "Chrome", "Edge",
]
INTERVAL_TITLE_PARTS = ["— mozilla firefox", "- google chrome", "- microsoft edge", "- safari", "["]
APP_DISPLAY_NAMES = {
    "code": "VSCode", "chrome": "Chrome", "firefox": "Firefox", "msedge": "Edge", "notepad++": "Notepad++",
    "sublime_text": "Sublime", "pycharm64": "PyCharm", "idea64": "IntelliJ", "slack": "Slack", "discord": "Discord",
    "teams": "Teams", "zoom": "Zoom",
}
SYSTEM_APPS = ["dwm.exe", "explorer.exe", "taskmgr.exe", "SystemSettings.exe", "ApplicationFrameHost.exe"]
GENERIC_TITLES = ["desktop", "task manager", "settings", "start menu", "notification"]

# fixed values: domain detection; (domain, task category, title words, file endings, site parts, app parts)
DOMAINS = [
    ("coding", "deep_development",
     ["code", "python", "javascript", "typescript", "html", "css", "github", "git", "vscode", "visual studio", "pycharm",
      "intellij", "sublime", "editor", "function", "class", "debug", "terminal", "console", "repository"],
     [".py", ".js", ".ts", ".html", ".css", ".json", ".yaml", ".md"], [],
     ["code.exe", "pycharm64.exe", "sublime_text.exe", "notepad++.exe"]),
    ("documentation", "technical_research",
     ["docs", "documentation", "api", "reference", "guide", "tutorial", "readme", "wiki", "manual", "help"],
     [], ["docs.", "documentation.", "readthedocs", "github.io"], []),
    ("communication", "team_meeting",
     ["slack", "discord", "teams", "zoom", "meet", "chat", "message", "email", "gmail", "outlook", "mail", "conversation"],
     [], [], ["slack.exe", "discord.exe", "teams.exe", "zoom.exe"]),
    ("research", "technical_research",
     ["google", "search", "stackoverflow", "reddit", "wikipedia", "article", "blog", "tutorial", "how to", "learn"],
     [], ["google.com", "stackoverflow.com", "reddit.com", "wikipedia.org"], []),
    ("productivity", "administrative_work",
     ["notion", "trello", "asana", "jira", "ticket", "task", "project", "calendar", "schedule", "meeting", "todo", "checklist"],
     [], [], ["notion.exe", "trello.exe", "asana.exe"]),
    ("content", "context_switching",
     ["youtube", "video", "watch", "stream", "netflix", "spotify", "music", "podcast", "article", "news"],
     [], ["youtube.com", "netflix.com", "spotify.com"], []),
]

# fixed values: named tools found in titles, one pattern per group, tried in order
TOOL_PATTERNS = [
    r"\b(react|vue|angular|node|python|javascript|typescript|java|c\+\+|rust|go)\b",
    r"\b(git|github|gitlab|bitbucket)\b",
    r"\b(vscode|pycharm|intellij|sublime)\b",
    r"\b(aws|azure|gcp|docker|kubernetes)\b",
]
NAME_PATTERN = r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)*)\b"

# fixed values: word lists of the tokenizers
FEATURE_STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was",
    "are", "were", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "can", "this", "that", "these", "those", "it", "its", "there", "here",
]
DISTANCE_STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was",
    "are", "were",
]
CLUSTER_STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
]
NAMING_NOISE = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "page", "tab",
    "untitled", "new",
]

# fixed values: indicator words of the segment features, in feature order
DOMAIN_WORDS = [
    ("domain_coding", ["code", "git", "github", "vscode", "python", "javascript", "programming", "develop", "debug", "commit", "branch", "repo"]),
    ("domain_docs", ["doc", "documentation", "readme", "wiki", "guide", "tutorial", "manual", "help", "reference"]),
    ("domain_comm", ["chat", "slack", "teams", "email", "message", "meet", "zoom", "call", "discord", "telegram"]),
    ("domain_research", ["search", "google", "stackoverflow", "research", "article", "blog", "news", "reddit"]),
    ("domain_prod", ["calendar", "todo", "task", "notion", "trello", "jira", "confluence", "spreadsheet", "excel"]),
    ("domain_content", ["youtube", "video", "music", "spotify", "netflix", "twitter", "facebook", "instagram", "social"]),
]
TITLE_PARTS = [
    ("has_code", [".py", ".js", ".ts", ".java", ".cpp", "github", "gitlab", "vscode", "visual studio", "pycharm", "intellij"]),
    ("has_docs", ["docs", "readme", "wiki", "documentation", "api reference"]),
    ("has_comm", ["slack", "teams", "discord", "telegram", "whatsapp", "messenger", "chat", "zoom", "meet"]),
]

# fixed values: one-hot positions
ONEHOT_APPS = [
    "firefox.exe", "chrome.exe", "code.exe", "notepad.exe", "slack.exe", "teams.exe", "outlook.exe", "excel.exe",
    "word.exe", "pycharm64.exe", "sublime_text.exe", "unknown",
]
ONEHOT_TIMES = ["morning", "afternoon", "evening", "night"]
ONEHOT_DURATIONS = ["very_short", "short", "medium", "long"]
ONEHOT_TASKS = [
    "administrative_work", "deep_development", "technical_research", "context_switching", "team_meeting", "strategic_planning",
]

# fixed values: app families of the segment similarity and the score of two apps of one family
SIMILARITY_FAMILIES = [
    (["chrome", "firefox", "edge", "safari", "msedge", "opera", "brave"], 0.7),
    (["vscode", "code", "pycharm", "idea", "eclipse", "sublime", "atom", "vim"], 0.7),
    (["word", "excel", "powerpoint", "outlook", "onenote"], 0.7),
    (["slack", "teams", "zoom", "discord", "skype"], 0.8),
]
# fixed values: app categories of the segment distance, first match wins
APP_CATEGORIES = [
    ("browser", ["firefox", "chrome", "edge", "safari", "brave"]),
    ("ide", ["code", "vscode", "pycharm", "intellij", "sublime", "atom", "vim", "emacs"]),
    ("communication", ["slack", "teams", "discord", "telegram", "zoom", "meet"]),
    ("office", ["word", "excel", "powerpoint", "outlook", "onenote"]),
    ("terminal", ["terminal", "cmd", "powershell", "bash", "iterm"]),
]
RELATED_TASKS = [("deep_development", "technical_research"), ("team_meeting", "administrative_work")]
