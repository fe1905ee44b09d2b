"""Framework knowledge as stub Ruby of our own: names that a program gets from libraries it doesn't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "(stubs)"

#: Read as any source, in the lowest layer; files end in .rbi, so real source is preferred.
STUBS = {
    "activerecord.rbi": """
module ActiveRecord
  class Base
    extend Querying
    def self.transaction(**options, &block); end
    def self.create(attributes = nil, &block); end
    def self.create!(attributes = nil, &block); end
    def initialize(attributes = nil, &block); end
    def save(**options); end
    def save!(**options); end
    def update(attributes); end
    def update!(attributes); end
    def destroy; end
    def destroy!; end
    def delete; end
    def reload(options = nil); end
    def valid?(context = nil); end
    def persisted?; end
    def new_record?; end
    def errors; end
    def attributes; end
    def assign_attributes(attributes); end
    def id; end
  end
  module Querying
    def find(*ids); end
    def find_by(*conditions); end
    def find_by!(*conditions); end
    def where(*conditions); end
    def order(*columns); end
    def all; end
    def first(limit = nil); end
    def last(limit = nil); end
    def count(*columns); end
    def pluck(*columns); end
    def exists?(conditions = :none); end
    def joins(*tables); end
    def includes(*tables); end
    def limit(value); end
  end
end
""",
    "activesupport.rbi": """
module ActiveSupport
  module Concern
    def included(base = nil, &block); end
    def class_methods(&block); end
  end
  def self.on_load(name, options = {}, &block); end
  def self.run_load_hooks(name, base = Object); end
end
class Object
  def blank?; end
  def present?; end
  def presence; end
  def try(*arguments, &block); end
end
""",
    "activejob.rbi": """
module ActiveJob
  class Base
    def self.perform_later(*arguments); end
    def self.perform_now(*arguments); end
    def self.set(options = {}); end
  end
end
""",
    "rspec.rbi": """
module RSpec
  module Matchers
    def expect(value = nil, &block); end
    def eq(expected); end
    def be(*expected); end
    def include(*expected); end
    def raise_error(*expected, &block); end
  end
  module Core
    class ExampleGroup
      include RSpec::Matchers
      def self.describe(*arguments, &block); end
      def self.context(*arguments, &block); end
      def self.it(*arguments, &block); end
      def self.let(name, &block); end
      def self.subject(name = nil, &block); end
      def self.before(*arguments, &block); end
      def self.after(*arguments, &block); end
    end
  end
end
""",
    "kernel.rbi": """
module Kernel
  def puts(*objects); end
  def print(*objects); end
  def p(*objects); end
  def raise(*arguments); end
  def require(name); end
  def require_relative(name); end
  def format(text, *arguments); end
  def loop(&block); end
  def lambda(&block); end
  def proc(&block); end
  def freeze; end
  def dup; end
  def is_a?(type); end
  def respond_to?(name, all = false); end
  def send(name, *arguments, &block); end
  def public_send(name, *arguments, &block); end
  def tap(&block); end
  def then(&block); end
  def inspect; end
  def to_s; end
  def nil?; end
  def instance_variable_get(name); end
  def instance_variable_set(name, value); end
end
class Object
  include Kernel
end
""",
}


def with_stubs(spark: SparkSession, scan: DataFrame, checkouts: DataFrame, stubs: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """scan and checkouts with the stubs (ours, or a caller's) as one more checkout, of kind core."""
    rows = spark.createDataFrame([(ROOT, p, t) for p, t in (stubs or STUBS).items()], "checkout string, path string, text string")
    more = rows.select("checkout", "path", F.col("text").cast("binary").alias("content"))
    one = spark.createDataFrame([(ROOT, "core")], "root string, kind string")
    return scan.select("checkout", "path", "content").unionByName(more), checkouts.select("root", "kind").unionByName(one)
