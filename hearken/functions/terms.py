"""Default term lists, taxonomies, statuses and thresholds. Every operator takes its lists as parameters."""

from __future__ import annotations

# promotion and interface words
PROMO_TERMS = ("ib", "inbox", "ref", "chot don", "mo the", "mo tk", "booking", "sale", "khuyen mai", "uu dai khung")
UI_NOISE_TERMS = ("like", "comment", "share", "thich", "binh luan", "chia se", "xem them", "view more", "most relevant")
SEVERE_UI_NOISE = ("like comment share", "thich binh luan chia se", "view more", "xem them")
TRANSACTIONAL_TERMS = ("xin gia", "gia bn", "bao nhieu", "ib", "inbox", "check ib", "check inbox", "con hang", "ship")

# query building
QUESTION_SUFFIXES = ("co tot khong", "co uy tin khong", "co nen dung khong")
COMPLAINT_PREFIXES = ("loi", "phi", "chan", "te", "bi khoa", "bi tru")
TRUST_TERMS = ("trust", "uy tin", "lua dao", "fraud", "scam", "bi lua")
COST_TERMS = ("phi", "fee", "lai", "interest", "chi phi", "gia cao")
SYMPTOM_TERMS = ("kich ung", "mun", "da nhay cam", "side effect", "tac dung phu", "pain")
IMAGE_TERMS = ("hinh anh", "co anh", "review co anh", "truoc va sau", "before after", "screenshot", "anh that", "video")
COMPLAINT_TERMS = ("fake", "lua dao", "loi", "te")
PROMO_REASONS = ("promot", "seller", "commercial", "cta", "transactional")
TARGET_REASONS = ("target", "mention", "brand", "entity")
PLACEHOLDERS = (
    "public-groups", "private-groups", "approved-private-groups", "join-requests", "from step-", "keyword", "comments from",
    "discovered from", "in groups from",
)
KEYWORD_GROUPS = ("brand", "pain_points", "sentiment", "behavior", "comparison")

# sources
BROKER_TERMS = (
    "vay tien", "vay von", "ho tro vay", "tin dung", "the chap", "tra gop", "dao han", "rut tien", "mo the", "tai chinh", "finance",
)
DISCUSSION_TERMS = ("review", "hoi dap", "kinh nghiem", "phan hoi", "so sanh", "cong dong", "khach hang")
LEAD_TERMS = ("ho tro", "mien phi", "lai suat thap", "tu van")
SOURCE_FILTER_TRIGGERS = ("consumer", "borrower", "end user", "comparison", "promotional", "advertiser", "representative", "transactional")
RESERVED_GROUPS = ("feed", "discover", "search", "category", "create", "membership_approval")
PRIVATE_MARKERS = ("private", "riêng tư", "closed", "kín")
PUBLIC_MARKERS = ("public", "công khai")

# rule judge: markers on lower-cased text with its accents
JUDGE_TRANSACTIONAL = ("xin gia", "gia bn", "ib", "inbox", "check ib", "con hang")
JUDGE_PROMOTIONAL = ("sale", "khuyen mai", "uu dai", "ref", "dai ly", "order")
JUDGE_EXPERIENCE = ("minh", "mình", "da dung", "trai nghiem", "bị", "bi", "gap", "gặp", "da mun", "phi", "loi")
JUDGE_COMPARISON = ("so sanh", "vs", "tot hon", "hơn")
JUDGE_QUESTION = ("co ai", "cho em hoi", "cho minh hoi")

# theme rules
THEME_COMPARISON = ("so voi", "tot hon", "hơn")
THEME_PAIN = ("phi", "cham", "cao qua", "khong on", "lỗi", "loi")
THEME_POSITIVE = ("thich", "tot", "on", "nhanh", "hai long")

# label heuristics: regular expressions by family, in this order
LABEL_PATTERNS = {
    "seller": (
        r"\bib\b", r"\binbox\b", r"\bzalo\b", r"li[eê]n h[ệe]", r"\bhotline\b", r"đăng ký|dang ky|mở thẻ|mo the|tư vấn|tu van",
        r"ưu đãi|uu dai|khuyến mãi|khuyen mai|combo|deal|ref",
    ),
    "official": (
        r"fanpage ch[íi]nh th[ứu]c|fanpage chinh thuc|official", r"\bcskh\b|chăm sóc khách hàng|cham soc khach hang", r"thông báo|thong bao",
    ),
    "admin": (r"\badmin\b", r"\bmod\b", r"quản trị viên|quan tri vien", r"duyệt bài|duyet bai|nội quy|noi quy"),
    "question": (r"cho em hỏi|cho minh hoi|cho mình hỏi|xin review", r"có ai|co ai|ai biết|ai biet", r"nên|nen|sao|thế nào|the nao"),
    "experience": (
        r"mình dùng|minh dung|em dùng|em dung", r"mình bị|minh bi|em bị|em bi", r"trải nghiệm|trai nghiem|review",
        r"phí|phi|lỗi|loi|hoàn tiền|hoan tien|từ chối|tu choi",
    ),
    "support": (r"vui lòng|vui long", r"liên hệ inbox|lien he inbox", r"ad check ib|page hỗ trợ|page ho tro"),
    "comparison": (r"so sánh|so sanh|\bvs\b", r"khác gì|khac gi|hơn|hon"),
}

# second-stage rule labeller
RULE_SELLER = ("ib", "zalo", "đăng ký", "dang ky", "mở thẻ", "mo the")
RULE_OFFICIAL = ("official", "cskh", "fanpage", "thông báo", "thong bao")
RULE_USER = ("cho em hỏi", "cho em hoi", "co ai", "có ai", "trải nghiệm", "trai nghiem", "mình", "minh")
RULE_ASKS = ("?", "hỏi", "hoi")

# taxonomy
TAXONOMY_VERSION = "v1"
AUTHOR_ROLES = ("end_user", "seller_affiliate", "brand_official", "community_admin", "unknown")
CONTENT_INTENTS = ("experience", "question", "promotion", "support_answer", "comparison", "other")
COMMERCIALITY_LEVELS = ("low", "medium", "high")
RELEVANCE_LEVELS = ("high", "medium", "low")
LABEL_SOURCES = ("heuristic", "ai", "hybrid", "fallback")
AUDIENCES = ("end_user_only", "include_seller", "include_brand")
SEARCH_ACTIONS = ("SEARCH_POSTS", "SEARCH_IN_GROUP", "CRAWL_FEED")
WEAK_CLUSTERS = ("generic_weak", "target_weak", "promo_noise")
WEAK_STOPS = ("zero_accepted_batches_exceeded", "weak_batches_exceeded", "min_accepts_not_reached")
TERMINAL_EVENTS = ("DONE", "FAILED", "CANCELLED", "ERROR")
