"""Date functions. Civil dates are TIMESTAMP_NTZ, so no session time zone and no
daylight-saving jump can enter; event times are instants from epoch seconds."""

from pyspark.sql import functions as F


def event_time(epoch_seconds):
    return F.timestamp_seconds(epoch_seconds)


def parse_date(text):
    """Reads the form `5/31/2021 12:00 PM`."""
    return F.to_timestamp_ntz(text, F.lit("M/d/yyyy h:mm a"))


def seconds_between(start, end):
    return F.timestamp_diff("SECOND", start, end)


def plus_seconds(start, seconds):
    return F.timestamp_add("SECOND", seconds, start)


def date_text(moment):
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def texts_from(spark, start, span):
    """A function that gives the `date_text` of a column of whole seconds after `start`, from 0 to `span`.

    Texts of days, of minutes of a day and of seconds are made once, here; a row only puts three of them together.
    """
    moment = plus_seconds(start, F.lit(0))
    since = F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
    passed = spark.range(1).select(since).first()[0]
    day = plus_seconds(start, F.col("id") * 86_400)
    count = (passed + span) // 86_400 + 1
    days = [r[0].split(" ")[0] for r in spark.range(count).select(date_text(day)).orderBy("id").collect()]
    minutes = [f" {at // 60:02}:{at % 60:02}:" for at in range(1440)]

    def one_of(texts, at):
        return F.get(F.split(F.lit("|".join(texts)), r"\|"), at.cast("int"))

    def text(seconds):
        at = seconds + passed
        return F.concat(
            one_of(days, F.floor(at / 86_400)), one_of(minutes, F.floor(at % 86_400 / 60)),
            one_of([f"{at:02}" for at in range(60)], at % 60),
        )

    return text
