"""Where topics live: on a Kafka broker, or in folders of files."""

from pagestream.sources import topics
from pagestream.streaming import sinks


class KafkaTopics:
    # Offsets of different partitions do not compare.
    result_order = ("sent_at", "offset")

    def __init__(self, servers, **options):
        self.servers, self.options = servers, options

    def lines(self, spark, topic):
        """A stream of `value` rows."""
        return topics.kafka_stream(spark, self.servers, topic, **self.options).select("value")

    def results(self, spark, names=topics.RESULT_TOPICS):
        """A stream of result messages, see `schemas.RESULT`."""
        return topics.kafka_results(topics.kafka_stream(spark, self.servers, names, **self.options))

    def line_sink(self, topic, writer):
        return sinks.kafka_sink(self.servers, topic)

    def write_lines(self, rows, topic, writer, batch_id):
        """Lines of one micro-batch; a repeated batch sends them again."""
        options = {"kafka.bootstrap.servers": self.servers, "topic": topic}
        rows.write.format("kafka").options(**options).save()

    def result_sink(self, topic):
        return sinks.kafka_sink(self.servers, topic)

    def write_results(self, rows, topic, batch_id):
        """Result messages of one micro-batch; a repeated batch sends them again."""
        self.write_lines(rows.select("key", "value"), topic, None, batch_id)


class FileTopics:
    """Lines in `<root>/<topic>/`, results in `<root>/results/topic=<topic>/batch_id=<n>/`.

    Each writer of a line topic has a folder of its own in it, `writer=<name>/batch_id=<n>`,
    so several jobs can feed one topic; files put there by hand are read too.
    """

    result_order = ("offset", "sent_at")

    def __init__(self, root, files_per_trigger=None):
        self.root, self.files_per_trigger = root, files_per_trigger

    def lines(self, spark, topic):
        return topics.line_stream(spark, f"{self.root}/{topic}", self.files_per_trigger).select("value")

    def results(self, spark, names=topics.RESULT_TOPICS):
        return topics.file_result_stream(spark, f"{self.root}/results", names, self.files_per_trigger)

    def line_sink(self, topic, writer):
        return sinks.batch_sink(lambda rows, batch_id: self.write_lines(rows, topic, writer, batch_id))

    def write_lines(self, rows, topic, writer, batch_id):
        """Lines of one micro-batch; a repeated batch replaces them.

        A stream that had read the first files reads the new ones too, so a reader that
        counts may count such a batch twice, as with a broker.
        """
        rows.write.mode("overwrite").text(f"{self.root}/{topic}/writer={writer}/batch_id={batch_id}")

    def result_sink(self, topic):
        return sinks.topic_folder_sink(f"{self.root}/results", topic)

    def write_results(self, rows, topic, batch_id):
        rows.write.mode("overwrite").parquet(f"{self.root}/results/topic={topic}/batch_id={batch_id}")
