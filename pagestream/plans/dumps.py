"""Dumps: cut into files, replayed at a set pace, looked at from the end."""

from pagestream.operators import ordering
from pagestream.sources import files
from pagestream.streaming import replay, sinks

ROWS_PER_FILE = 50_000


def split_dump(lines, folder, rows_per_file=ROWS_PER_FILE):
    """Files of at most that many lines, for rows that lie in no order."""
    sinks.write_split_files(lines, folder, rows_per_file)


def split_files(spark, path, folder, rows_per_file=ROWS_PER_FILE):
    """The lines of a dump in files of that many lines, in line order by name."""
    sinks.write_numbered_lines(files.numbered_lines(spark, path), folder, rows_per_file)


def last_lines(spark, path, n=200):
    """Files are taken from the last by name backwards, twice as many each time, until they
    hold `n` lines; those before are not opened."""
    names = sorted(files.scan_lines(spark, path).inputFiles())
    taken = 1
    while True:
        lines = files.scan_lines(spark, [replay.literal(name) for name in names[-taken:]] or path)
        if taken >= len(names) or lines.limit(n).count() == n:
            break
        taken *= 2
    return ordering.tail_lines(lines, n)


def replay_dump(spark, folder, write, checkpoint, **pace):
    """The files of a folder by name; `write(lines, batch_id)` gets those of each batch."""
    return replay.replay_by_name(spark, folder, write, checkpoint, **pace)
