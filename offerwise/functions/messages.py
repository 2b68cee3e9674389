"""Coupon-field messages and fetched pages, classified by wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerwise.functions.text import RUPEE, SPACE, WORD_END, WORD_START, parse_amount, squeeze

_S = SPACE

# Wording of the four verdicts.
BLOCKED = (
    rf"(?i)sign{_S}?in|log{_S}?in|login|register"
    rf"|{WORD_START}otp{WORD_END}|verification{_S}+code"
    rf"|captcha|are{_S}+you{_S}+a{_S}+human|verify{_S}+you{_S}+are{_S}+human"
    rf"|unusual{_S}+traffic|access{_S}+denied|blocked"
)
REJECTED = (
    rf"(?i)invalid{_S}+(?:coupon|code|promo)"
    rf"|coupon{_S}+(?:is{_S}+)?(?:invalid|expired|not{_S}+valid)"
    rf"|code{_S}+(?:is{_S}+)?(?:invalid|expired|incorrect|not{_S}+found)"
    rf"|does{_S}+not{_S}+exist|no{_S}+longer{_S}+(?:valid|available)"
    rf"|cannot{_S}+be{_S}+used|not{_S}+applicable|已过期|不可用"
)
CONDITIONAL = (
    rf"(?i)min(?:imum)?{_S}+(?:order|spend|purchase|amount)"
    rf"|add{_S}+(?:more{_S}+)?items?|not{_S}+eligible"
    rf"|only{_S}+(?:for|valid{_S}+for){_S}+(?:new|first|selected)"
    rf"|selected{_S}+(?:items?|products?)|spend{_S}+{RUPEE}?{_S}*[0-9,]+{_S}+more"
)
ACCEPTED = (
    rf"(?i)coupon{_S}+applied|promo(?:tion)?{_S}+code{_S}+applied|discount{_S}+applied"
    rf"|applied{_S}+successfully|you{_S}+saved|coupon{_S}+discount"
)
MESSAGE_MINIMUM = (
    rf"(?i)min(?:imum)?{_S}*(?:order|spend|purchase|amount|cart)?{_S}*(?:value|of|is|:)?"
    rf"{_S}*{RUPEE}?{_S}*([0-9,]+)"
)
MESSAGE_SAVED = rf"(?i)(?:you{_S}+saved|discount|saving){_S}*[:\-]?{_S}*{RUPEE}{_S}*([0-9,]+)"

# Challenge-page markers, tried in this order on the first 20,000 characters.
CHALLENGES = (
    (r"(?i)just a moment\.\.\.", "cloudflare interstitial"),
    (r"(?i)cf-browser-verification|cf_chl_opt|cf-challenge", "cloudflare challenge"),
    (r"(?i)<title>[^<]*attention required[^<]*</title>", "cloudflare block page"),
    (r"(?i)g-recaptcha|recaptcha/api\.js|hcaptcha\.com/1/api\.js", "captcha widget"),
    (r"(?i)px-captcha|perimeterx", "perimeterx challenge"),
    (
        r"(?i)are you a human|verify you are human|unusual traffic from your",
        "human verification",
    ),
    (r"(?i)akamai reference number|access denied.*akamai", "akamai block page"),
)


def challenge_reason(body: Column, status: Column) -> Column:
    """Why a fetched page is a challenge or block page; null for an ordinary page."""
    walled = status.isin(403, 429, 503) & body.rlike("(?i)captcha|blocked|challenge")
    reason = F.when(
        walled, F.concat(F.lit("http "), status.cast("string"), F.lit(" with block markers"))
    )
    for pattern, detail in reversed(CHALLENGES):
        reason = F.when(body.rlike(pattern), F.lit(detail)).otherwise(reason)
    return reason


def verdict(message: Column) -> Column:
    """accepted / rejected / conditional / blocked / unavailable, a blocker winning."""
    return (
        F.when(message.rlike(BLOCKED), "blocked")
        .when(message.rlike(REJECTED), "rejected")
        .when(message.rlike(CONDITIONAL), "conditional")
        .when(message.rlike(ACCEPTED), "accepted")
        .otherwise("unavailable")
    )


def verdict_detail(verdict_col: Column, message: Column, code: Column) -> Column:
    summary = F.substring(squeeze(message), 1, 200)
    return (
        F.when(
            verdict_col == "blocked",
            F.lit("sign-in / OTP / verification requested after applying the code"),
        )
        .when(verdict_col == "rejected", F.concat(F.lit("coupon field rejected "), code))
        .when(
            verdict_col == "conditional",
            F.concat(F.lit("code recognised but conditions unmet: "), summary),
        )
        .when(
            verdict_col == "accepted",
            F.concat(F.lit("coupon field accepted "), code, F.lit(": "), summary),
        )
        .otherwise(F.lit("response could not be interpreted with confidence"))
    )


def terms_in_message(message: Column) -> dict[str, Column]:
    """Terms a coupon-field message discloses, null where it does not."""
    minimum = parse_amount(F.regexp_extract(message, MESSAGE_MINIMUM, 1))
    saved = parse_amount(F.regexp_extract(message, MESSAGE_SAVED, 1))
    return {
        "observed_minimum": minimum,
        "observed_value": saved,
        "observed_type": F.when(saved.isNotNull(), F.lit("flat")),
    }


def new_text(before: Column, after: Column) -> Column:
    """Text present after an interaction but not before it."""
    lines = rf"\n|\.{SPACE}"
    strip = lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")
    seen = F.transform(F.split(before, lines, -1), strip)
    fresh = F.filter(
        F.transform(F.split(after, lines, -1), strip),
        lambda x: (x != "") & ~F.array_contains(seen, x),
    )
    return (
        F.when(F.coalesce(before, F.lit("")) == "", after)
        .when(after.startswith(before), F.substring(after, F.length(before) + 1, F.length(after)))
        .otherwise(F.array_join(fresh, " "))
    )
