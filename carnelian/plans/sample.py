"""A small program of our own, as rows: what the Ruby queries read where no checkout is given."""

from __future__ import annotations

FILES: list[tuple[str, str, str]] = [
    ("shop", "app/models/application_record.rb", "class ApplicationRecord < ActiveRecord::Base\n  self.abstract_class = true\nend\n"),
    (
        "shop",
        "app/models/order.rb",
        """# An order of a customer.
# It has lines.
class Order < ApplicationRecord
  include Priced
  extend Search
  belongs_to :customer
  has_many :lines, class_name: "OrderLine"
  enum :state, { open: 0, paid: 1 }
  scope :recent, -> { order(:created_at) }
  attr_accessor :note
  delegate :city, to: :customer, prefix: true

  MAX = 10
  Line = OrderLine

  def total(tax = 0)
    sum = lines.sum(&:price)
    sum = Money.new(sum) if tax.zero?
    sum.round
  end

  def pay!(card, amount: nil)
    charge = Charge.new(card)
    charge.run(amount || total)
    notify
    self
  end

  def self.import(rows)
    rows.each { |row| new(row).save }
  end

  def old_total; total; end

  private

  def notify
    Mailer.order_paid(self).deliver_later
  end

  def leftover; end
end
""",
    ),
    ("shop", "app/models/order_line.rb", "class OrderLine < ApplicationRecord\n  belongs_to :order\n  def price = quantity * unit\n  def total(x); super; end\nend\n"),
    ("shop", "app/models/special_order.rb", "class SpecialOrder < Order\n  prepend Audited\n  def total(tax = 0)\n    super + fee\n  end\n  def fee = 5\n  alias cost total\nend\n"),
    ("shop", "app/models/concerns/priced.rb", "module Priced\n  extend ActiveSupport::Concern\n  included do\n    include Comparable\n  end\n  class_methods do\n    def cheapest = recent.first\n  end\n  def <=>(other) = total <=> other.total\n  def price_tag\n    \"#{total} EUR\"\n  end\nend\n"),
    ("shop", "app/models/concerns/search.rb", "module Search\n  def lookup(id)\n    find(id)\n  end\n  def never_called; end\nend\nmodule Audited\n  def pay!(card, amount: nil)\n    log(:pay)\n    super\n  end\n  def log(what); end\nend\n"),
    ("shop", "app/services/charge.rb", "class Charge\n  attr_reader :card\n  def initialize(card)\n    @card = card\n    @gate = Gate::Client.new\n  end\n  def run(amount)\n    @gate.send_money(card, amount)\n    Order.new.customer_city\n    result = amount > 5 ? Gate::Ok.new : Gate::Failed.new(1)\n    result.report\n  rescue Gate::Error => e\n    e.report\n  end\nend\n"),
    ("shop", "lib/gate.rb", "module Gate\n  class Client\n    %w[a b].each { |n| x = n }\n    [1].each { |n| define_method(\"get_#{n}\") { n } }\n    define_method(dyn) { 1 }\n    def send_money(card, amount); end\n    def method_missing(name, *args); end\n  end\n  class Result\n    def report; end\n  end\n  Ok = Class.new(Result)\n  class Failed < Result\n    def initialize(code); @code = code; end\n    def report; super; end\n  end\n  class Error < StandardError; end\n  Money = Struct.new(:amount) do\n    def round = amount\n  end\n  module Tools::Deep\n    HELPER = Client\n    HELPER.new.send_money(1, 2)\n  end\n  module Tools; end\nend\nMoney = Gate::Money\n"),
    ("shop", "app/controllers/orders_controller.rb", "class OrdersController < ApplicationController\n  before_action :load, only: :show\n  def show\n    render :show, locals: { order: @order }\n  end\n  def index\n    @orders = Order.recent\n  end\n  def orphan; end\n  private\n  def load\n    @order = Order.find(params[:id])\n    @order.pay!(params[:card])\n  end\nend\n"),
    ("shop", "app/jobs/import_job.rb", "class ImportJob < ApplicationJob\n  def perform(rows)\n    Order.import(rows)\n    SpecialOrder.lookup(3).total(1)\n  end\nend\n"),
    ("shop", "app/models/customer.rb", "class Customer < ApplicationRecord\n  def city = 'Ulm'\nend\n"),
    ("shop", "app/views/orders/show.html.erb", "<h1><%= @order.total %></h1>\n<% @order.lines.each do |line| %>\n  <%= line.price %>\n<% end %>\n"),
    ("shop", "app/views/orders/index.html.haml", "%h1 Orders\n- @orders.each do |order|\n  %p= order.price_tag\n"),
    ("shop", "spec/models/order_spec.rb", "describe Order do\n  it 'pays' do\n    order = Order.new\n    order.pay!(1)\n    order.old_total\n    Search.new.never_called\n  end\nend\n"),
    ("shop", "spec/models/line_spec.rb", "require 'spec_helper'\nrequire_relative '../../lib/gate'\nshared_examples 'priced' do\n  let(:extra) { 1 }\n  it { extra; cost }\nend\nshared_examples 'nobody' do\nend\ndescribe OrderLine do\n  let(:line) { OrderLine.new }\n  let(:unused) { 1 }\n  let(:cost) { line.price }\n  include_examples 'priced'\n  it 'counts' do\n    expect(line.price).to eq(cost)\n    expect(subject).to be_ready\n  end\n  context 'free' do\n    let(:line) { SpecialOrder.new }\n    it('is') { line.fee; extra }\n  end\nend\n"),
    ("shop", "app/views/orders/_line.html.erb", "<%= line.price %>\n"),
    ("shop", "app/views/orders/list.html.erb", "<%= render 'line', line: @line %>\n<%= render partial: 'orders/line' %>\n"),
    ("shop", "app/helpers/money_helper.rb", "module MoneyHelper\n  def euro(x); send(\"as_#{x}\"); end\n  def as_cents; end\nend\n"),
    ("shop", "lib/tasks/run.rb", "require 'gate'\nrequire 'json'\nload 'tasks/run.rb'\nKlass = 'ImportJob'.constantize\n"),
    ("shop", "lib/plugins.rb", "module Acting\n  def act; end\nend\nmodule Plugin\n  def self.extended(x); end\n  def acts_as_actor\n    include Acting\n  end\nend\nclass Host\n  def self.acts\n    include Acting\n  end\n  ActiveSupport.run_load_hooks(:host, self)\nend\nclass Guest < Host\n  acts\nend\nmodule Late; def late; end; end\nActiveSupport.on_load(:host) { include Late }\n"),
    ("shop", "lib/one.rb", "class Split < Host\nend\n"),
    ("shop", "lib/two.rb", "class Split < Order\nend\n"),
    ("shop", "config/routes.rb", "Rails.application.routes.draw do\n  resources :orders, only: [:index, :show]\n  namespace(:admin) { resource :profile }\nend\n"),
    ("shop", "db/schema.rb", "ActiveRecord::Schema.define(version: 3) do\n  create_table \"orders\" do |t|\n    t.string \"state\", null: false\n    t.decimal \"amount\"\n    t.bigint \"customer_id\"\n    t.index [\"customer_id\"]\n    t.timestamps\n  end\n  create_table \"order_lines\" do |t|\n    t.integer \"quantity\"\n    t.jsonb \"extra\"\n  end\nend\n"),
    ("shop", "sig/broken.rb", "class Broken\n  def a(\n  x = ]\nend\nclass Fine\n  def ok; end\nend\n"),
]

TEXTS: list[tuple[str, str, str]] = [
    ("shop", "db/structure.sql", "CREATE TABLE public.users (\n  id bigint NOT NULL,\n  email character varying(255) DEFAULT ''::character varying NOT NULL,\n  tags text[],\n  at timestamp without time zone\n);\nALTER TABLE ONLY public.users ADD CONSTRAINT users_pkey PRIMARY KEY (id);\nCREATE UNIQUE INDEX by_email ON public.users USING btree (email);\n"),
    ("shop", "Gemfile.lock", "GEM\n  remote: https://gems.example/\n  specs:\n    money (2.1.0)\n      tools (~> 1.2)\n    tools (1.3.1)\nPATH\n  remote: .\n  specs:\n    shop (0.1)\n"),
    ("shop", "Gemfile", "gem 'money', '~> 2.0'\ngem 'tools'\n"),
    ("shop", "config/settings.yml", "job: ImportJob\nhandler: price_tag\nport: 80\n"),
    ("shop", "sig/money.rbs", "class Money < Object\n  include Comparable\n  def round: () -> Integer\n  def split: (Integer n, ?Integer m) -> Array[Money]\n           | (Integer n) -> Array[Money]\n  def self.parse: (String text) -> Money\nend\n"),
    ("shop", "lib/generated/api.rb", "# Generated by a tool. DO NOT EDIT.\nclass Api; end\n"),
]
