"""Readers, for batch and for streams. Where a broker is named, the Kafka connector
package has to be on the class path."""
